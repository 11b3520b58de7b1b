"""The best representative of each duplicate group, field by field, under a latent two-sided quality model.

Every value that a group's leads state for a field is a fact that is true or false; several of one group can be true. A
source has a sensitivity (it states a true value) and a specificity (it does not state a false one), and
both, the share of true facts and the probability of each fact are inferred by expectation-maximisation
over all groups, until nothing moves. A source is an origin together with the standing of the lead that speaks for it: among the
group's leads with a value, is it the latest, the most trusted, both, or neither. So recency and
trust are evidence of the model, as strong as the groups' agreement shows them to be. One thing is known beforehand:
a lead that is strictly first in both outweighs all others together (its specificity is a fixed prior).

The survivor's value is the one with the greatest log-odds, from the lead whose source speaks most for it; all values judged true are kept.

Groups are never gathered. The model sees only patterns (which sources are present, which of them state the value)
with their numbers, and a pattern holds each source once, however many leads a group has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.moments import normalise_moments
from siftwell.operators.skew import lookup_join
from siftwell.session import materialise, observed

# Texts that stand for a missing value, as letters and digits only.
STAND_INS = ["na", "none", "null", "nil", "unknown", "tbd", "tbc", "tba", "notavailable", "notapplicable", "unbekannt", "inconnu", "desconocido", "keine", "missing", "test", "x", "xx", "xxx"]
FIELDS = ("job_title", "lead_score")
#: Most origins whose parameters the model keeps on the driver; more raise ValueError.
MOST_SOURCES = 2_000
#: So many patterns are fitted in one task.
LOCAL_PATTERNS = 200_000
#: The standings of a lead in its group, the last one being strictly first in both recency and trust (or alone).
STANDINGS = ("neither", "latest", "trusted", "both", "first")
#: Log-odds that one source can add or take, and those that the first standing adds: more than all the sources of a group that patterns have had here, 30, could take.
LIMIT, FIRST = 3.0, 100.0


def real_title(title: Column) -> Column:
    """The trimmed title, or null where it is blank, only marks, or a stand-in."""
    bare = F.lower(F.regexp_replace(title, r"(?U)[^\p{L}\p{N}]+", ""))
    return F.when((bare != "") & ~bare.isin(STAND_INS), F.regexp_replace(title, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def real_score(score: Column) -> Column:
    return F.when(score.between(0, 100), score.cast("string"))


def candidates(leads: DataFrame, groups: DataFrame, origins: DataFrame) -> DataFrame:
    """(group_id, field, id, value, origin, trust, at): one row per lead of a group and field with a real value.

    at is the readable updated_at in microseconds, the smallest number where there is none; trust is -1 for unknown origins.
    """
    members = groups.select("group_id", "id").distinct()
    own = leads.select("id", "job_title", "lead_score", "origin", "updated_at").join(members, "id")
    own = materialise(own.dropDuplicates(["id", "group_id"]), "members")
    moments = normalise_moments(own.select("id", "origin", "updated_at"), origins, fields=("updated_at",)).groupBy("id").agg(F.max("utc_micros").alias("at"))
    trust = origins.groupBy("origin").agg(F.max("trust").alias("trust"))
    cells = F.explode(F.array(F.struct(F.lit("job_title").alias("field"), real_title(F.col("job_title").cast("string")).alias("value")), F.struct(F.lit("lead_score").alias("field"), real_score(F.col("lead_score")).alias("value"))))
    rows = own.join(moments, "id", "left").join(trust, "origin", "left").select("group_id", "id", F.coalesce("origin", F.lit("")).alias("origin"), F.coalesce("trust", F.lit(-1)).alias("trust"), F.coalesce("at", F.lit(-(2**62))).alias("at"), cells.alias("x"))
    return rows.select("group_id", "x.field", "id", "x.value", "origin", "trust", "at").filter("value is not null")


def with_standing(rows: DataFrame) -> DataFrame:
    """rows with standing (an index of STANDINGS); first is a lead that is alone, or strictly the latest and strictly the most trusted.

    The greatest and the smallest id at the top are the same where the top is held alone: one aggregation, no second pass.
    """
    top = lambda c: [F.max(F.struct(c, "id")).alias(f"{c}_hi"), F.max(F.struct(F.col(c), (-F.col("id")).alias("k"))).alias(f"{c}_lo")]
    tops = rows.groupBy("group_id", "field").agg(*top("at"), *top("trust"))
    marked = lookup_join(rows, tops, ["group_id", "field"], "inner")
    alone = lambda c: (F.col(f"{c}_hi.id") == F.col("id")) & (F.col(f"{c}_lo.k") == -F.col("id"))
    high = lambda c: F.col(c) == F.col(f"{c}_hi").getField(c)
    standing = F.when(alone("at") & alone("trust"), 4).when(high("at") & high("trust"), 3).when(high("trust"), 2).when(high("at"), 1).otherwise(0)
    return marked.withColumn("standing", standing).drop("at_hi", "at_lo", "trust_hi", "trust_lo")


class Quality:
    """Sensitivity and specificity of each source of a field, and the share of true facts. A source's number is 5 * origin + standing."""

    def __init__(self, sources: int) -> None:
        self.sens, self.spec, self.prior = np.full(sources, 0.8), np.full(sources, 0.8), 0.5
        self.first = np.arange(sources) % len(STANDINGS) == len(STANDINGS) - 1

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Log-odds that each source adds if it states a fact, if it does not, and those of any fact."""
        yes = np.clip(np.log(self.sens / (1 - self.spec)), -LIMIT, LIMIT)
        no = np.clip(np.log((1 - self.sens) / self.spec), -LIMIT, LIMIT)
        return np.where(self.first, FIRST, yes), no, float(np.log(self.prior / (1 - self.prior)))

    def learn(self, sums: np.ndarray, facts: float, true: float) -> float:
        """The M step from the rows (true and stated, true, false and not stated, false) of each source, with Beta(2, 2) priors; the greatest change."""
        sens, spec = (sums[0] + 2) / (sums[1] + 4), (sums[2] + 2) / (sums[3] + 4)
        prior = min(0.99, max(0.01, (true + 1) / (facts + 2)))
        change = max(np.abs(sens - self.sens).max(), np.abs(spec - self.spec).max(), abs(prior - self.prior))
        self.sens, self.spec, self.prior = sens, spec, prior
        return float(change)


def expected(patterns: pd.DataFrame, yes: np.ndarray, no: np.ndarray, prior: float) -> tuple[np.ndarray, float, float]:
    """One E step over patterns (present, says, n): the sums for Quality.learn."""
    sums, facts, true = np.zeros((4, len(yes))), 0.0, 0.0
    if len(patterns):
        present, says = patterns["present"].to_list(), patterns["says"].to_list()
        n = patterns["n"].to_numpy(float)
        row_p, row_s = np.repeat(np.arange(len(n)), [len(x) for x in present]), np.repeat(np.arange(len(n)), [len(x) for x in says])
        at_p, at_s = np.concatenate(present).astype(np.int64), np.concatenate(says).astype(np.int64)
        z = prior + np.bincount(row_p, no[at_p], len(n)) + np.bincount(row_s, (yes - no)[at_s], len(n))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        size = len(yes)
        stated, here = np.bincount(at_s, (p * n)[row_s], size), np.bincount(at_p, (p * n)[row_p], size)
        false_stated, false_here = np.bincount(at_s, ((1 - p) * n)[row_s], size), np.bincount(at_p, ((1 - p) * n)[row_p], size)
        sums, facts, true = np.array([stated, here, false_here - false_stated, false_here]), float(n.sum()), float((p * n).sum())
    return sums, facts, true


def _expected_by_field(frame: pd.DataFrame, given: dict[str, tuple[np.ndarray, np.ndarray, float]]) -> dict[str, tuple[np.ndarray, float, float]]:
    return {f: expected(frame[frame["field"] == f], *w) for f, w in given.items()}


def _fit(patterns: DataFrame, quality: dict[str, Quality], here: bool, most_rounds: int, close: float) -> None:
    """Rounds of expectation and maximisation until no parameter of a field moves by `close`, or most_rounds. here: all of it in one task; else a round is one job, of which a row a task and field reaches the driver."""
    if not quality:
        return
    size = len(next(iter(quality.values())).sens)
    live = dict.fromkeys(quality, True)

    def rounds(given, total) -> None:
        for f in given:
            if quality[f].learn(total[f][0].reshape(4, size), total[f][1], total[f][2]) < close:
                del live[f]

    if here:

        def whole(batches):
            frames = list(batches)
            frame = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({"field": [], "present": [], "says": [], "n": []})
            for _ in range(most_rounds):
                if not live:
                    break
                given = {f: quality[f].weights() for f in live}
                rounds(given, _expected_by_field(frame, given))
            yield pd.DataFrame({"field": list(quality), "sens": [q.sens for q in quality.values()], "spec": [q.spec for q in quality.values()], "prior": [q.prior for q in quality.values()]})

        for r in patterns.coalesce(1).mapInPandas(whole, "field string, sens array<double>, spec array<double>, prior double").collect():
            q = quality[r["field"]]
            q.sens, q.spec, q.prior = np.array(r["sens"]), np.array(r["spec"]), r["prior"]
        return
    for _ in range(most_rounds):
        if not live:
            return
        given = {f: quality[f].weights() for f in live}

        def step(batches, given=given):
            total = {f: [np.zeros((4, size)), 0.0, 0.0] for f in given}
            for b in batches:
                for f, found in _expected_by_field(b, given).items():
                    total[f] = [x + y for x, y in zip(total[f], found, strict=True)]
            yield pd.DataFrame({"field": list(total), "sums": [t[0].ravel() for t in total.values()], "facts": [t[1] for t in total.values()], "true": [t[2] for t in total.values()]})

        got = patterns.mapInPandas(step, "field string, sums array<double>, facts double, true double").toPandas()
        own = {f: got[got["field"] == f] for f in given}
        rounds(given, {f: (np.sum(np.array(x["sums"].to_list()), axis=0), x["facts"].sum(), x["true"].sum()) for f, x in own.items()})


def infer_quality(rows: DataFrame, most_rounds: int = 1000, close: float = 1e-4, local_patterns: int = LOCAL_PATTERNS) -> tuple[DataFrame, dict[str, Quality], list[str]]:
    """(facts, quality, origins): facts has group_id, field, value, z (log-odds) of every stated value; quality one model a field; origins the order of their numbers.

    rows: group_id, field, value, origin, standing. See _fit for the rounds; up to local_patterns patterns are fitted in one
    task, more in a job a round.
    """
    spark = rows.sparkSession
    names = sorted(r[0] for r in rows.select("origin").distinct().limit(MOST_SOURCES + 1).collect())
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} origins; the model keeps the parameters of at most so many")
    size = len(names) * len(STANDINGS)
    number = F.broadcast(spark.createDataFrame([(o, i * len(STANDINGS)) for i, o in enumerate(names)], "origin string, _o int"))
    claims = rows.join(number, "origin").select("group_id", "field", "value", (F.col("_o") + F.col("standing")).alias("s"))
    stated = claims.groupBy("group_id", "field", "value").agg(F.sort_array(F.collect_set("s")).alias("says"))  # at most one entry a source
    present = claims.groupBy("group_id", "field").agg(F.sort_array(F.collect_set("s")).alias("present"))
    seen = materialise(lookup_join(stated, present, ["group_id", "field"], "inner"), "claims")
    patterns, found = observed(seen.groupBy("field", "present", "says").agg(F.count(F.lit(1)).alias("n")), "patterns", n=F.count(F.lit(1)), fields=F.collect_set("field"))
    fields = sorted(found["fields"] or [])
    quality = {f: Quality(size) for f in fields}
    _fit(patterns, quality, found["n"] <= local_patterns, most_rounds, close)
    table = {f: quality[f].weights() for f in fields}
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    z = F.lit(None).cast("double")
    for f, (yes, no, prior) in table.items():
        sum_of = lambda column, v: F.aggregate(F.transform(column, lambda s: F.element_at(numbers(v), s + 1)), F.lit(0.0), lambda a, b: a + b)
        z = F.when(F.col("field") == f, F.lit(prior) + sum_of("present", no) + sum_of("says", yes - no)).otherwise(z)
    return seen.select("group_id", "field", "value", z.alias("z")), quality, names


def choose(rows: DataFrame, facts: DataFrame, quality: dict[str, Quality], names: list[str]) -> DataFrame:
    """One row (group_id, field, id, value, z, decided) per group and field with a real value: the value with the greatest z, from the lead whose source speaks most for it.

    Ties go to the higher trust, the later moment, the smaller id. decided: an exact check of the chosen lead, that it is the only
    one with a value or strictly the latest and strictly the most trusted.
    """
    spark = rows.sparkSession
    voices = spark.createDataFrame([(f, o, s, float(q.weights()[0][i * len(STANDINGS) + s])) for f, q in quality.items() for i, o in enumerate(names) for s in range(len(STANDINGS))], "field string, origin string, standing int, voice double")
    heard = rows.join(F.broadcast(voices), ["field", "origin", "standing"])  # at most 10 * MOST_SOURCES short rows
    scored = lookup_join(heard, facts, ["group_id", "field", "value"], "inner")
    order = F.struct(F.round("z", 6).alias("z"), "voice", "trust", "at", (-F.col("id")).alias("k"), "value", "standing")
    chosen = scored.groupBy("group_id", "field").agg(F.max(order).alias("o"))
    return chosen.select("group_id", "field", (-F.col("o.k")).alias("id"), F.col("o.value").alias("value"), F.col("o.z").alias("z"), (F.col("o.standing") == len(STANDINGS) - 1).alias("decided"))


def survivors(leads: DataFrame, groups: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, kept) of the groups (group_id, id) of duplicate leads: see choose(); kept has (group_id, field, value, z) of every value judged true, and of the chosen one in any case.

    Leads without a real value of a field (null, blank, a stand-in, a score outside 0-100) do not take part in
    it; a group without any has no row for the field. Missing or unreadable updated_at count as earliest;
    repeated rows of a lead count once; other columns are ignored; empty tables give no rows.
    """
    rows = materialise(with_standing(materialise(candidates(leads, groups, origins), "fields")), "standings")
    facts, quality, names = infer_quality(rows)
    facts = materialise(facts, "facts")
    chosen = materialise(choose(rows, facts, quality, names), "chosen")
    best = chosen.select("group_id", "field", F.col("value").alias("_best"))
    kept = lookup_join(facts, best, ["group_id", "field"], "inner").filter((F.col("z") >= 0) | (F.col("value") == F.col("_best"))).drop("_best")
    return chosen, kept
