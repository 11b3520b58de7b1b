import random

import pytest
from pyspark.sql import functions as F

from siftwell.config import EngineConfig
from siftwell.functions import clean
from siftwell.operators import adjudicate, blocking, evaluate, resolve, scoring
from siftwell.operators.components import connected_components
from siftwell.operators.skew import hot_keys, lookup_join

SCHEMA = "id bigint, first string, last string, full string, company_name string, email string, phone_raw string, country string, job_title string, notes string"


def leads(spark, rows):
    """Rows of (id, first, last, company, email, phone[, country]) as stored leads."""
    full = [(r[0], r[1], r[2], None, r[3], r[4], r[5], r[6] if len(r) > 6 else None, None, None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    n = clean.resolved_name(F.col("first"), F.col("last"), F.col("full"))
    d = clean.phone_digits(F.col("phone_raw"))
    dom = clean.email_domain(F.col("email"))
    return df.select("*", *[v.alias(k) for k, v in n.items()], clean.company_core(F.col("company_name")).alias("company_core"), clean.email_local(F.col("email")).alias("email_local"), dom.alias("email_domain"), clean.domain_root(dom).alias("domain_root"), d.alias("phone_digits"), clean.phone_key(d).alias("phone_key"), F.lit("New").alias("status"))


GOLD = [
    # same person reformatted, abbreviated, colleagues
    ((1, "Erik", "Almeida", "Lotus Finance Pte. Ltd.", "erik.a@lotusfinance.biz", "+65 8123 4567"), (2, "Erik", "Almeida", "Lotus Finance Analytics", "erikalmeida@lotusfinance.biz", "6581234567"), 0.90, 1.0),
    ((1, "Erik", "Almeida", "Lotus Finance", "erik.a@lotusfinance.biz", "+65 8123 4567"), (2, "Mona", "Almeida", "Lotus Finance", "mona@lotusfinance.biz", "+65 9000 1111"), 0.0, 0.1),
    ((1, "Erik", "Almeida", "Lotus Finance", "erik.a@lotusfinance.biz", "1"), (2, "Erik", "Almeida", "Hooli", "ealmeida@hooli.com", "2"), 0.0, 0.4),
]


@pytest.mark.parametrize(("a", "b", "low", "high"), GOLD)
def test_bands(spark, a, b, low, high):
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    s = scoring.score_pairs(pairs, leads(spark, [a, b])).first()
    assert low <= s["score"] <= high


def test_blank_names_and_nulls(spark):
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    s = scoring.score_pairs(pairs, leads(spark, [(1, None, None, None, None, None), (2, None, None, None, None, None)])).first()
    assert s["name_sim"] == 1.0 and s["score"] is not None and list(s["reasons"]) == ["identical name"]


def test_marker_changes_no_score(spark):
    df = leads(spark, [GOLD[0][0], GOLD[0][1]])
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    marked = df.withColumn("notes", F.lit("Possible duplicate - verify before contacting."))
    assert scoring.score_pairs(pairs, df).first()["score"] == scoring.score_pairs(pairs, marked).first()["score"]


def test_block_guard(spark):
    rows = [(i, f"N{i}", f"Fam{i}", "Big", f"u{i}@big.test", None) for i in range(120)]
    df = leads(spark, rows)
    assert blocking.block_stats(df).agg(F.sum("oversized")).first()[0] >= 1
    assert blocking.block_pairs(df).count() < 120 * 119 / 2
    assert blocking.block_pairs(df, max_block=200).count() == 120 * 119 / 2


def test_only_the_ngram_join_finds(spark):
    rows = [(i, w, w + "son", w, None, None) for i, w in enumerate("quartz plume oxbow zephyr fjord gizmo kayak lynx".split())]
    rows += [(100, "Annabelle", "Thistlewood", "Marigold", None, None), (101, "Thistlewood", "Annabelle", "Marigold", None, None)]
    df = leads(spark, rows)
    assert blocking.block_pairs(df).filter("a = 100 and b = 101").count() == 0
    found = blocking.candidate_pairs(df).filter("a = 100 and b = 101").collect()
    assert [list(r["blocked_by"]) for r in found] == [["ngram"]]


def test_ngram_join_is_exact(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["alma", "bruno", "carla", "alba", "bruna", "carlo"]) + rng.choice(["ni", "ti", "x"]) for _ in range(2))) for i in range(60)] + [(60, None), (61, "")], "id bigint, text string")
    v = {}
    for r in blocking.ngram_vectors(docs).filter("usable").collect():
        v.setdefault(r["id"], {})[r["gram"]] = r["w"]
    want = set()
    for a in v:
        s = sorted(((-round(sum(w * v[b].get(g, 0) for g, w in v[a].items()), 9), b) for b in v if b != a))[:8]
        want |= {(a, b) for x, b in s if -x >= 0.35}
    assert {(r["a"], r["b"]) for r in blocking.ngram_neighbours(docs).collect()} == want
    for index_docs, asked_docs in ((7, 5), (20, 64)):  # many blocks
        monkeypatch.setattr(blocking, "INDEX_DOCS", index_docs)
        monkeypatch.setattr(blocking, "ASKED_DOCS", asked_docs)
        assert {(r["a"], r["b"]) for r in blocking.ngram_neighbours(docs).collect()} == want
    assert blocking.ngram_neighbours(docs.limit(0)).count() == 0


def test_neighbours_write_no_more_than_the_documents(spark):
    """Vectors are neither repeated for blocks nor shuffled by gram: the files of a run grow with the documents (before: 150 copies at 300,000)."""
    import os

    rng = random.Random(5)
    syllables = "al ma bru no car la to ri ven dor quis zet".split()
    docs = spark.createDataFrame([(i, " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(4))) for i in range(2000)], "id bigint, text string")
    found = blocking.ngram_neighbours(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "Generate" not in plan
    v = {}
    for r in blocking.ngram_vectors(docs).filter("usable").collect():
        v.setdefault(r["id"], {})[r["gram"]] = r["w"]
    got = {}
    for r in found.orderBy("a", "place").collect():
        got.setdefault(r["a"], []).append((r["b"], round(r["score"], 9)))
    for a in range(0, 2000, 97):
        s = sorted((-round(sum(w * v[b].get(g, 0) for g, w in v[a].items()), 9), b) for b in v if b != a)[:8]
        assert [b for b, _ in got.get(a, [])] == [b for x, b in s if -x >= 0.35], a
        assert all(abs(x + y) < 2e-9 for (_, x), (y, _) in zip(got.get(a, []), s))
    path = next(p for p in found.inputFiles() if "vectors" in p).removeprefix("file://")
    folder = os.path.dirname(path)
    assert sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder)) < 2000 * 400


def test_parts_give_the_same_scores_and_leave_no_shuffle(spark, sf, monkeypatch, tmp_path):
    """Pairs scored in parts are those scored at once, and what a step shuffles is gone when it is written (before: it stayed until the driver collected garbage)."""
    import pathlib

    from siftwell import session

    df = spark.read.parquet(f"{sf}/leads.parquet")
    pairs = session.materialise(blocking.block_pairs(df), "test")
    one = {tuple(r) for r in resolve.scored(df, EngineConfig(), pairs=pairs).select("a", "b", "score", F.array_join("blocked_by", ",")).collect()}
    monkeypatch.setattr(resolve, "PART_PAIRS", 0)
    monkeypatch.setattr(resolve, "PARTS", 3)
    assert one and {tuple(r) for r in resolve.scored(df, EngineConfig(), pairs=pairs).select("a", "b", "score", F.array_join("blocked_by", ",")).collect()} == one
    where = pathlib.Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    count = lambda: len(list(where.rglob("shuffle_*.data")))
    before = count()
    session.materialise(df.repartition(3).groupBy("country").count(), "test")
    assert count() <= before
    assert spark.conf.get(session.CLEANUP) == "false" or spark.conf.get(session.CLEANUP) is None


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {(r["id"], r["root"]) for r in connected_components(df).collect()} == {(x, find(x)) for x in list(parent)}
    assert connected_components(df.limit(0)).count() == 0


def test_groups_do_not_depend_on_order(spark):
    rows = [(1, "Erik", "Almeida", "Lotus", "e@lotus.test", "81234567"), (2, "E.", "Almeida", "Lotus", "ealmeida@lotus.test", "81234567"), (3, "Erik", "Almeida", "Lotus Ltd", "e@lotus.test", None), (9, "Zoe", "Quill", "Hooli", "z@hooli.test", "99999999")]
    out = []
    for order in (rows, rows[::-1]):
        g, stats = resolve.resolve(leads(spark, order))
        out.append([(r["group_id"], list(r["lead_ids"]), r["confidence"]) for r in g.collect()])
        s = stats.first()
        assert s["records"] == 4 and s["full_pairwise_comparisons"] == 6 and s["groups"] == 1 and s["records_in_groups"] == 3
    assert out[0] == out[1] and out[0][0][1] == [1, 2, 3]
    g, stats = resolve.resolve(leads(spark, rows[:1]))
    assert g.count() == 0 and stats.first()["reduction_ratio"] == 0.0
    with pytest.raises(ValueError):
        resolve.resolve(leads(spark, rows), limit=-1)


def test_verdicts(spark):
    cfg = EngineConfig()
    df = spark.createDataFrame([(1, 0.95, 1.0, 0.0, 1.0), (2, 0.5, 1.0, 0.0, 1.0), (3, 0.5, 0.0, 0.0, 0.5), (4, 0.5, 0.0, 0.0, 0.9)], "a bigint, score double, phone_exact double, email_exact double, name_sim double")
    got = {r["a"]: r for r in adjudicate.apply_verdicts(df, adjudicate.heuristic_verdict(), cfg).collect()}
    assert got[1]["verdict"] is None and got[1]["score"] == 0.95
    assert got[2]["score"] == pytest.approx(0.995) and got[3]["score"] == pytest.approx(0.08)
    assert got[4]["verdict"]["verdict"] == "unsure" and got[4]["score"] == 0.5


def test_chain_and_cache(spark):
    def down(_):
        raise OSError("no network")

    chain = adjudicate.Chain([adjudicate.Adjudicator("first", down), adjudicate.Adjudicator("second", lambda _: '```json\n{"verdict": "same", "confidence": 1}\n```')])
    assert chain({"x": 1})["provider"] == "second" and len(chain.errors) == 1 and chain.usage() == {"first": 1, "second": 1}
    with pytest.raises(RuntimeError):
        adjudicate.Chain([adjudicate.Adjudicator("bad", lambda _: {"verdict": "maybe"})])({})
    req = spark.createDataFrame([(1, 2, '{"k": 1}', "h1"), (3, 4, '{"k": 1}', "h1"), (5, 6, '{"k": 2}', "h2")], "a bigint, b bigint, request string, key string")
    answers, cache = adjudicate.ask_model(req, lambda r: {"verdict": "same", "confidence": 0.5, "reason": "", "provider": "t", "model": None} if r["k"] == 1 else down(r), "t")
    got = {r["a"]: r["answer"]["verdict"] for r in answers.collect()}
    assert got == {1: "same", 3: "same", 5: "unsure"} and cache.count() == 1
    again, _ = adjudicate.ask_model(req.filter("a < 5"), down, "t", cache)
    assert {r["answer"]["verdict"] for r in again.collect()} == {"same"}


def test_labels_and_metrics(spark):
    rows = [(10, "Erik", "Almeida", "L", "e@lotus.test", None), (11, "E.", "Almeida", "L", "a@lotus.test", None), (12, "Mona", "Almeida", "L", "m@lotus.test", None), (20, "Erik", "Almeida", "L", "e@lotus.test", None)]
    assert [(r["a"], r["b"]) for r in evaluate.label_pairs(leads(spark, rows)).collect()] == [(10, 11)]
    scored = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.6)], "a bigint, b bigint, score double")
    truth = spark.createDataFrame([(1, 2), (4, 5)], "a bigint, b bigint")
    r = {x["threshold"]: x for x in evaluate.confusion(scored, truth).collect()}[0.9]
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (1, 0, 1, 1.0, 0.5)
    assert {x["outcome"] for x in evaluate.pair_sets(scored, truth).collect()} == {"recovered", "missed", "extra"}
    e = evaluate.exact_groups(scored.select("a", "b"), truth).first()
    assert (e["true_groups"], e["found_groups"], e["exact"]) == (2, 1, 0)


def test_lookup_join_with_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).when(F.col("id") < 3005, None).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(1, 7)], "k bigint, v bigint"))
    for how in ("left", "inner"):
        plain = rows.join(table, ["k"], how).select("k", "id", "v")
        split = lookup_join(rows, table, ["k"], how, share=0.1, least=100).select("k", "id", "v")
        assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_components_in_rounds_and_in_one_task_agree(spark):
    rng = random.Random(11)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(900 + i, 901 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(90)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    here, rounds = (sorted(map(tuple, connected_components(df, local_links=n).collect())) for n in (10**6, 0))
    assert here == rounds and len(here) > 400


def test_few_hot_keys_reach_the_driver(spark):
    """300 keys above the least number of rows: only those above the share are collected."""
    rows = spark.range(61_000).select(F.when(F.col("id") < 31_000, -1).otherwise(F.col("id") % 300).alias("k"))
    assert [(r["k"], r["_n"]) for r in hot_keys(rows, ["k"], share=0.1, least=50)] == [(-1, 31_000)]
    assert hot_keys(rows.filter("k >= 0"), ["k"], share=0.1, least=50) == []


def test_a_name_of_one_word_blocks(spark):
    df = leads(spark, [(1, "Cher", None, None, None, None), (2, "Cher", None, None, None, None), (3, None, None, None, None, None)])
    assert [tuple(r) for r in blocking.block_pairs(df).collect()] == [(1, 2, ["initial_surname"])]
