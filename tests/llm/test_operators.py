import random

import pytest
from pyspark.sql import functions as F

from siftwell.llm import canonical, encoding, grouping, incremental, mixing, pii, pii_table, residue, survivors, variants
from siftwell.llm.people import domain_core, firm_core, mailbox, person, phone_line, same_name

# ---------- 1: personal information


@pytest.fixture(scope="module")
def tagger():
    return pii.model()


def test_held_out_accuracy():
    """Notes made of sentences that the tagger never saw: every fifth frame is kept from it."""
    tagger = pii.train(held_out=False)
    held = pii_table.labelled_notes(400, seed=991, held_out=True)
    found = pii.find_in([t for t, _ in held], *tagger)
    hit = sum(len({(a, b) for a, b, _ in s} & {(a, b) for a, b, _ in f}) for (_, s), f in zip(held, found, strict=True))
    want, got = sum(len(s) for _, s in held), sum(len(f) for f in found)
    assert hit / want > 0.9 and hit / got > 0.9


def test_the_labelled_table_shares_no_sentence_with_the_notes(spark):
    import re

    notes = [r["notes"] for r in spark.read.parquet("/root/testdata/sf0.01/leads.parquet").select("notes").filter("notes is not null").distinct().collect()]
    text = "\n".join(notes)
    for frame in pii_table._frames(pii_table.FRAMES) + pii_table._frames(pii_table.PLAIN):
        for piece in re.split(r"\{[^}]*\}", frame.replace("\x00", " | ")):
            assert len(piece.strip()) < 12 or piece.strip() not in text, frame


def test_spans_and_redaction(spark):
    notes = ["Reach them on +293 (0)593.705.289 or kes.mira@ked.co.example.", None, "", "  ", "Ticket #774048 still open. Tracking ZX8161927638.", "new contact Ana Brenvik. " + "Good fit. " * 4000 + "Call +259 20 505 8925 after 4."]
    df = spark.createDataFrame([(i, n) for i, n in enumerate([*notes, notes[0]])], "id bigint, notes string").withColumn("text", F.lit("x")).withColumn("kind", F.lit("y"))
    got = {(r["id"], r["kind"], r["value"]) for r in pii.find_spans(df.unionByName(df)).collect()}
    for i in (0, 6):
        assert {(i, "PHONE", "+293 (0)593.705.289"), (i, "EMAIL", "kes.mira@ked.co.example")} <= got
    assert {(5, "NAME", "Ana Brenvik"), (5, "PHONE", "+259 20 505 8925")} <= got and not any(i in (1, 2, 3, 4) for i, _, _ in got)
    clean = {r["id"]: r["notes"] for r in pii.redact(df).collect()}
    assert clean[0] == "Reach them on [PHONE] or [EMAIL]." and clean[1] is None and clean[3] == "  " and clean[4] == notes[4]
    assert pii.find_spans(df.limit(0)).count() == 0


def test_viterbi_against_brute_force(tagger):
    """The best tag sequence of short texts by trying all sequences of a few tags."""
    import itertools

    import numpy as np

    W, T = tagger
    for text in ("Call 123456789", "Ana Lima", "see x"):
        x, s, e = pii.features(text)
        E = W[x].sum(axis=1)
        best = max(itertools.product(range(pii.K), repeat=len(s)), key=lambda y: float(T[pii.K, y[0]] + sum(E[i, t] for i, t in enumerate(y)) + sum(T[a, b] for a, b in itertools.pairwise(y))))
        assert pii._spans(list(best), s, e) == pii.viterbi([text], W, T)[0] and np.isfinite(E).all()


# ---------- 2: survivors


def test_survivors(spark):
    leads = spark.createDataFrame(
        [
            (1, "Buyer", 10, "low", "2024-01-01"), (2, "CFO", 999, "high", "2024-05-01"), (3, "n/a", 50, "mid", None),  # 2 wins the title; the score ties between 1 and 3
            (4, " ", None, "low", "2024-01-01"), (5, "TBD", -1, "high", "2024-01-02"),  # no value at all
            (6, "Lead", 5, "low", "2024-03-01"), (7, "Chef", 7, "high", "2024-01-01"), (8, None, None, None, "never"),  # latest and most trusted differ
            (9, "Buyer", None, "zz", "2024-03-01"),  # the only one
        ],
        "id bigint, job_title string, lead_score int, origin string, updated_at string",
    ).withColumn("value", F.lit(1))
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (6, 6), (6, 7), (6, 8), (8, 9)], "group_id bigint, id bigint")
    origins = spark.createDataFrame([("low", "UTC", "mdy", 1), ("mid", "UTC", "mdy", 2), ("high", "UTC", "mdy", 3)], "origin string, zone_name string, slash_order string, trust int")
    chosen, kept = survivors.survivors(leads.unionByName(leads), groups.unionByName(groups), origins)
    got = {(r["group_id"], r["field"]): r for r in chosen.collect()}
    assert {k for k, r in got.items() if r["decided"]} == {(1, "job_title"), (8, "job_title")}
    assert got[1, "job_title"]["id"] == 2 and got[8, "job_title"]["id"] == 9 and (4, "job_title") not in got
    assert {(g, f, r["value"]) for (g, f), r in got.items()} <= {(r["group_id"], r["field"], r["value"]) for r in kept.collect()}
    for empty in (survivors.survivors(leads.limit(0), groups, origins), survivors.survivors(leads, groups.limit(0), origins)):
        assert empty[0].count() == 0 and empty[1].count() == 0


def stated(spark, groups=120):
    """Groups of three origins, of which one mostly states something else."""
    rng = random.Random(4)
    rows = []
    for g in range(groups):
        truth = f"t{g % 7}"
        for k, origin in enumerate(("good", "fine", "bad")):
            rows.append((g, "job_title", g * 10 + k, truth if rng.random() < {"good": 0.95, "fine": 0.9, "bad": 0.2}[origin] else f"w{rng.randrange(50)}", origin, 1, 0, 0))
    return spark.createDataFrame(rows, "group_id bigint, field string, id bigint, value string, origin string, trust int, at bigint, standing int")


def test_quality_model_learns_the_bad_source(spark):
    _, quality, names = survivors.infer_quality(stated(spark))
    sens = {o: quality["job_title"].sens[i * 5] for i, o in enumerate(names)}
    assert sens["bad"] < 0.5 < sens["fine"] and sens["good"] > 0.8


def test_quality_model_against_plain_em(spark):
    """The patterns give what EM over every single fact gives."""
    import math

    df = stated(spark, 40)
    facts, quality, names = survivors.infer_quality(df)
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["group_id"], {}).setdefault(r["value"], set()).add(r["origin"])
    sens, spec, prior = dict.fromkeys(names, 0.8), dict.fromkeys(names, 0.8), 0.5
    clip = lambda x: max(-3.0, min(3.0, x))
    weigh = lambda says: math.log(prior / (1 - prior)) + sum(clip(math.log(sens[o] / (1 - spec[o]))) if o in says else clip(math.log((1 - sens[o]) / spec[o])) for o in names)
    for _ in range(100):
        p = {(g, v): 1 / (1 + math.exp(-weigh(says))) for g, own in groups.items() for v, says in own.items()}
        old = (dict(sens), dict(spec), prior)
        for o in names:
            t, f = sum(p.values()), sum(1 - x for x in p.values())
            sens[o] = (sum(x for (g, v), x in p.items() if o in groups[g][v]) + 2) / (t + 4)
            spec[o] = (sum(1 - x for (g, v), x in p.items() if o not in groups[g][v]) + 2) / (f + 4)
        prior = (sum(p.values()) + 1) / (len(p) + 2)
        if max([abs(sens[o] - old[0][o]) for o in names] + [abs(spec[o] - old[1][o]) for o in names] + [abs(prior - old[2])]) < 1e-4:
            break
    spread, _, _ = survivors.infer_quality(df, local_patterns=0)  # a job a round
    for r in facts.unionByName(spread).collect():
        assert r["z"] == pytest.approx(weigh(groups[r["group_id"]][r["value"]]), abs=1e-6)


def test_the_model_decides(spark):
    """With other log-odds, other leads are chosen and found."""
    df = stated(spark).withColumn("standing", F.when(F.col("origin") == "good", 4).otherwise(0))
    facts, quality, names = survivors.infer_quality(df)
    found = {r["id"] for r in survivors.choose(df, facts, quality, names).filter("decided").collect()}
    assert found == {g * 10 for g in range(120)}
    other = survivors.choose(df, facts.withColumn("z", F.rand(3)), quality, names).filter("decided")
    assert {r["id"] for r in other.collect()} != found


# ---------- 3 and 6: persons and firms

LEAD = "id bigint, batch_no int, display_name string, email string, phone_raw string, phone_digits string, domain_root string, company_name string"


def people_of(spark, rows):
    full = [(i, b, n, e, p, None, (e or "").partition("@")[2].partition(".")[0] or None, c) for i, b, n, e, p, c in rows]
    return spark.createDataFrame(full, LEAD).withColumn("key", F.lit(0)).withColumn("person", F.lit("x"))


PEOPLE = [
    (1, 0, "Ana Brenvik", "a.brenvik@quol.test", "+259 20 505 8925", "Quol Foods Ltd"),
    (2, 0, "BRENVIK Ana", None, "00259 205058925", None),  # the line
    (3, 1, "Ana Brenvkk", "info@quol.test", None, "The Quol Foods"),  # firm and name
    (4, 2, "Marek Brenvik", "m.brenvik@quol.test", "+259205058925", "Quol Foods"),  # a relative on the line
    (5, 3, None, "a.brenvik+news@quol.example", None, None),  # own mailbox without a name
    (6, 3, "Ana Brenvik", "ana@other.test", None, "Other Optics AG"),  # a namesake
    (7, 4, None, None, None, None),
    (8, 5, "A. Brenvik", "a.brenvik quol.test", None, None),  # no @
]


def rows_of(df):
    return {(r["earlier_id"], r["id"]) for r in df.collect()}


def test_new_batches_against_history(spark, tmp_path):
    leads = people_of(spark, PEOPLE)
    own = lambda n: leads.filter(F.col("batch_no") == n)
    path = f"file://{tmp_path}/index"
    index = incremental.DuplicateIndex.build(own(0), path)
    assert rows_of(index.check(own(1), 1)) == {(1, 3)} and rows_of(index.check(own(2), 2)) == set() and rows_of(index.check(own(3), 3)) == {(1, 5)}
    index = incremental.DuplicateIndex.load(spark, path)  # opened again
    assert rows_of(index.check(own(5).unionByName(own(5)), 5)) == {(1, 8)}
    assert rows_of(index.report()) == {(1, 3), (1, 5), (1, 8)} == rows_of(incremental.check_batches(leads))
    assert incremental.check_batches(leads.limit(0)).count() == 0 and incremental.check_batches(own(4)).count() == 0


def test_an_empty_batch_reads_no_history(spark, tmp_path):
    import shutil

    leads = people_of(spark, PEOPLE)
    index = incremental.DuplicateIndex.build(leads.filter("batch_no = 0"), f"file://{tmp_path}/index")
    shutil.rmtree(tmp_path / "index" / "blocks")
    assert index.check(leads.limit(0), 1).count() == 0
    assert index.check(leads.filter("id = 7"), 2).count() == 0  # a lead without any evidence


def test_stored_buckets_are_not_shuffled(spark, tmp_path):
    leads = people_of(spark, PEOPLE)
    index = incremental.DuplicateIndex.build(leads.filter("batch_no = 0"), f"file://{tmp_path}/index")
    _, names, _ = index._read(leads.filter("batch_no = 1"), index.given_names)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = incremental.met(incremental.rotated(names), spark.table(index.table))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(key") == 1 and "ShuffledHashJoin" in plan


def test_a_later_lead_shows_two_persons_to_be_one(spark):
    rows = [(1, 0, "Ana Brenvik", "ana@one.test", None, None), (2, 0, "Ana Brenvik", "ana@two.test", None, None), (3, 1, "A. Brenvik", "ana@two.test", None, None), (4, 2, "Ana Brenvik", "ana@one.test", None, "Two"), (5, 3, "Ana Brenvik", None, None, "Two")]
    leads = people_of(spark, rows)
    index = incremental.DuplicateIndex.build(leads.filter("batch_no = 0"))
    assert rows_of(index.check(leads.filter("batch_no = 1"), 1)) == {(2, 3)}
    assert rows_of(index.check(leads.filter("batch_no = 2"), 2)) == {(1, 4)}
    assert rows_of(index.report()) == {(1, 3), (1, 4)}
    assert rows_of(index.check(leads.filter("batch_no = 3"), 3)) == {(1, 5)}


def test_persons_in_one_task_and_in_rounds(spark):
    rng = random.Random(2)
    links = [(rng.randrange(100), 0, 100 + rng.randrange(200)) for _ in range(90)] + [(100 + rng.randrange(200), None, 100 + rng.randrange(200)) for _ in range(60)]
    df = spark.createDataFrame(links, "a bigint, a_batch int, b bigint").filter("a <> b")
    here, rounds = (sorted(map(str, incremental.persons_of(df, n).collect())) for n in (len(links), 10**9))
    assert here == rounds and "stored=True" in here[0]


def test_recall_of_the_index_against_brute_force(spark):
    """Of all pairs that share evidence and whose names can be one person's, nearly all end in one person."""
    import itertools

    from siftwell.llm.people import given_name_table, identities

    leads = spark.read.parquet("/root/testdata/sf0.01/leads.parquet")
    names = given_name_table(leads)
    index = incremental.DuplicateIndex.build(leads.withColumn("batch_no", F.lit(0)))
    who = {r["id"]: r["person"] for r in index._log().collect()}
    by = {}
    for r in identities(leads, names).collect():
        if r["family"]:
            for e in [("m", r["mailbox"]), ("l", r["line"]), *(("f", f) for f in r["firms"])]:
                if e[1]:
                    by.setdefault(e, []).append((r["id"], (r["given"], r["family"])))
    known, found, every = frozenset(names), 0, 0
    for own in by.values():
        for (i, a), (j, b) in itertools.combinations(own, 2):
            if same_name(a, b, known):
                every += 1
                found += i in who and who.get(i) == who.get(j)
    assert every > 500 and found / every >= 0.95


def test_variant_pairs(spark):
    got = {tuple(r) for r in variants.variant_pairs(people_of(spark, PEOPLE)).collect()}
    assert {("person", "1", "2"), ("person", "1", "3"), ("person", "1", "8")} <= got
    assert not any("4" in r[1:] or "6" in r[1:] or "7" in r[1:] for r in got if r[0] == "person")
    assert ("company", "Quol Foods", "Quol Foods Ltd") in got and ("company", "Quol Foods", "The Quol Foods") in got
    assert not any("Other" in r[1] or "Other" in r[2] for r in got)
    assert variants.variant_pairs(people_of(spark, PEOPLE).limit(0)).count() == 0


def test_refused_pairs_hold_namesakes_apart(spark):
    rows = [(i, 0, n, None, "+259 20 505 8925", None) for i, n in enumerate(["J Kimberlin", "Jane Kimberlin", "John Kimberlin"])]
    rows += [(10 + i, 0, n, "e.calezano@quol.test", None, None) for i, n in enumerate(["Ebba Calezano", "Ebba Cazano", "Ebba Calezan"])]  # three edits between the last two
    rows += [(20 + i, 0, n, None, None, None) for i, n in enumerate(f"{g} {f}" for g in ("Jane", "John", "Ebba") for f in ("Ost", "Quill", "Marwood"))]  # given names in use
    got = {tuple(r) for r in variants.variant_pairs(people_of(spark, rows)).collect()}
    assert ("person", "1", "2") not in got and len(got & {("person", "0", "1"), ("person", "0", "2")}) == 1
    assert {("person", "10", "11"), ("person", "10", "12"), ("person", "11", "12")} <= got


def plain_linkage(edges, threshold):
    """Average linkage, one merge at a time, over all pairs of two clusters; absent pairs count 0."""
    clusters = {i: {i} for e in edges for i in e}
    while True:
        best = None
        for x in sorted(clusters):
            for y in sorted(clusters):
                if x < y:
                    v = round(sum(edges.get((min(i, j), max(i, j)), 0.0) for i in clusters[x] for j in clusters[y]) / (len(clusters[x]) * len(clusters[y])), 9)
                    if v >= threshold and (best is None or (v, -x, -y) > best[0]):
                        best = ((v, -x, -y), x, y)
        if best is None:
            return {n: c for c, own in clusters.items() for n in own}
        clusters[best[1]] |= clusters.pop(best[2])


@pytest.mark.parametrize("seed", [8, 9])
def test_average_linkage_is_the_plain_one(spark, seed):
    """In one task, in rounds, and part by part with either way: exactly the clusters of single merges."""
    rng = random.Random(seed)
    edges = {}
    for block in range(4):
        for _ in range(40):
            a, b = sorted(rng.sample(range(block * 12, block * 12 + 12), 2))
            edges[a, b] = round(0.3 + 0.7 * rng.random(), 6)
    want = plain_linkage(edges, 0.4)
    assert len(set(want.values())) < len(want) and variants.linkage(edges, 0.4) == want
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a bigint, b bigint, sim double")
    for got in (variants.average_linkage(df, 0.4), variants.cluster_edges(df, 0.4), variants.cluster_edges(df, 0.4, here=0), variants.cluster_edges(df, 0.4, most=30, here=0)):
        assert {r["node"]: r["cluster"] for r in got.collect()} == want


def test_large_and_small_evidence_give_the_same_persons(spark):
    """The join in place and the join by trigram, for the same firm."""
    rng = random.Random(3)
    given, family = ["Ana", "Marek", "Ebba", "Omar", "Jane", "John"], ["Brenvik", "Calezano", "Quillmark", "Ostwald", "Marwood", "Kimberlin"]
    rows = []
    for i in range(150):
        g, f = rng.choice(given), rng.choice(family)
        k = rng.randrange(len(f) - 1)
        f = f if rng.random() < 0.6 else f[:k] + f[k + 1] + f[k] + f[k + 2 :]
        rows.append((i, 0, rng.choice([f"{g} {f}", f"{f.upper()} {g}", f"{g[0]}. {f}"]), None, None, "Quol Foods"))
    df = people_of(spark, rows)
    here, spread = ({(r["person"], r["id"]) for r in variants.link_persons(df, most=m).collect()} for m in (1000, 20))
    assert here == spread and len(here) > 100


def test_firms_are_compared_with_near_ones_only(spark, monkeypatch):
    rng = random.Random(8)
    parts = "ra vi ton mar kel dor zin pla fen gio hul bre sta wex yor nim".split()
    names = {"".join(rng.choices(parts, k=rng.choice((2, 3, 4)))) for _ in range(700)} | {"longname" * 5}
    for n in rng.sample(sorted(names), 150) + ["longname" * 5]:
        i = rng.randrange(1, len(n) - 1)
        names.add(rng.choice((n[:i] + n[i + 1 :], n[:i] + "x" + n[i:], n[:i] + n[i + 1] + n[i] + n[i + 2 :])))
    names = sorted(names)
    df = spark.createDataFrame([(n, None) for n in names], "company_name string, domain_root string")
    compared, judged = [], variants.judged
    monkeypatch.setattr(variants, "judged", lambda pairs, *more: compared.append(pairs.count()) or judged(pairs, *more))
    got = {}
    for r in variants.link_firms(df).collect():
        got.setdefault(r["firm"], set()).add(r["text"])
    core = {n: variants.firm_core(n) for n in names}
    weights = variants.gram_weights(spark.createDataFrame([(c,) for c in set(core.values())], "t string"), "t")
    cosine = variants.Vectors(weights, variants.FIRM_COSINE).cosine
    sims = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            v = cosine(core[a], core[b])
            if v >= variants.FIRM_COSINE and (x := variants._similarity(v, variants.firm_verdict(f"{core[a]}\t", f"{core[b]}\t"))) > 0:
                sims[j, i] = x
    want = {}
    for i, c in variants.linkage(sims, variants.FIRM_LINKAGE).items():
        want.setdefault(c, set()).add(names[i])
    several = lambda groups: sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert len(several(want)) > 50 and several(got) == several(want)
    assert sum(compared) < 4 * len(names)


def test_every_variant_comes_from_the_cosine_join(spark):
    """With a cosine that no pair of different vectors reaches, only equal vectors are linked."""
    df = people_of(spark, PEOPLE)
    near, none = ({(r["person"], r["id"]) for r in variants.link_persons(df, threshold=t).collect()} for t in (variants.PERSON_COSINE, 1.01))
    assert near == {(1, 1), (1, 2), (1, 3), (1, 8)} and none == {(1, 1), (1, 2)}
    typo = people_of(spark, [(1, 0, None, None, None, "Quolmark Foods Ltd"), (2, 0, None, None, None, "The Quolmrak Foods")])
    assert variants.link_firms(typo).count() == 2 and variants.link_firms(typo, threshold=1.01).count() == 0


def test_rows_of_a_key_stay_together():
    import pandas as pd

    rng = random.Random(1)
    keys = sorted(rng.randrange(9) - 4 for _ in range(60))
    at = sorted(rng.sample(range(60), 14))
    frames = [pd.DataFrame({"ev": keys[i:j], "x": range(i, j)}) for i, j in zip([0, *at], [*at, 60], strict=True)]
    out = list(variants._groups(iter(frames), "ev"))
    assert [x for o in out for x in o["x"]] == list(range(60)) and sum(o["ev"].nunique() for o in out) == len(set(keys))


def test_cosine_join_loses_no_pair(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abdeikmnorst") for _ in range(rng.randint(4, 9))) for _ in range(80)]
    words += [w[:-1] + "x" for w in words[:30]]
    rows = spark.createDataFrame([(0, i, w, w) for i, w in enumerate(words)], "w bigint, n bigint, t string, note string")
    weights = variants.gram_weights(rows.select("t"), "t")
    cosine = variants.Vectors(weights, 0.5).cosine
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if words[i] != words[j] and cosine(words[i], words[j]) >= 0.5}
    got = {(r["a"], r["b"]) for r in variants.cosine_pairs(rows, weights, 0.5).collect()}
    assert want and want <= got


def test_keys():
    assert mailbox("A.B+x@Quol.Test") == ("a.b@quol", False) and mailbox("info@x.test")[1] and mailbox(None) == ("", False)
    assert phone_line("+293 181545163 ext 83") == phone_line("0181/545163") == "181545163" and phone_line("none") == "" and phone_line("00000000") == ""
    assert firm_core("The Quas Palon Foods Pte. Ltd.") == firm_core("QUASPALON") == "quaspalon" and domain_core("tarmutek-insurance") == "tarmutek" and domain_core("postvane") == ""
    known = frozenset({"karin", "karim", "elizabeth"})
    assert same_name(person("Liz Volmark", known), person("Elizabeth Volmarc", known), known) and not same_name(person("Karin Dolstad", known), person("Karim Dolstad", known), known)
    assert same_name(person("K. Dolstad", known), person("Karin Dolstad", known), known) and not same_name(person("A. Dolstad", known), person("Karin Dolstad", known), known)


# ---------- 4: groups


def test_hash_to_min(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(1, 80)] + [(7, 7), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(links + links[:5] + [(b, a) for a, b in links[:9]], "a bigint, b bigint").withColumn("v", F.lit("x"))
    assert sorted((r["group_id"], r["id"]) for r in grouping.group_links(df).collect()) == sorted((find(x), x) for x in list(parent))
    assert grouping.group_links(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        grouping.group_links(df, max_rounds=1)


# ---------- 5: canonical values


def test_mapping(spark):
    ref = spark.createDataFrame([("country", c) for c in ("Niger", "Nigeria", "Germany", "South Korea", "United States")] + [("status_raw", s) for s in ("New", "Closed Won", "Qualified")] + [("owner_raw", "Karin Dolstad"), ("owner_raw", "Karim Dolstad"), ("owner_raw", "Omar Zelnov"), (None, "x"), ("country", None)], "field string, canonical string")
    rows = [("brand new", "DOLSTAD, Karin", "Deutschland"), ("CLOSED_WON", "O. Zelnov", "Germnay"), (" N e w", "ozelnov", "US"), ("qualifierd", "k. dolstad", "Korea (South)"), ("New", "Karin Dolstad", "Niger"), (None, " ", "\t"), ("???", "Petra Ulm", "Atlantis" * 300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, status_raw string, owner_raw string, country string").withColumn("canonical", F.lit("z")).withColumn("value", F.lit("z"))
    got = {(r["id"], r["field"]): r["canonical"] for r in canonical.map_values(df, ref).collect()}
    assert [got[i, "status_raw"] for i in range(4)] == ["New", "Closed Won", "New", "Qualified"]
    assert [got[i, "owner_raw"] for i in range(4)] == ["Karin Dolstad", "Omar Zelnov", "Omar Zelnov", "(unmatched)"]
    assert [got[i, "country"] for i in range(4)] == ["Germany", "Germany", "United States", "South Korea"]
    assert not any(i in (4, 5) for i, _ in got) and {got[6, f] for f in ("status_raw", "owner_raw", "country")} == {"(unmatched)"}
    shards = {(r["id"], r["field"]): r["canonical"] for r in canonical.map_values(df, ref, shard_size=4).collect()}
    assert shards == got
    assert canonical.map_values(df.limit(0), ref).count() == 0 and {r["canonical"] for r in canonical.map_values(df, ref.limit(0)).collect()} == {"(unmatched)"}


def test_shards_answer_like_one_tree(spark):
    """All typed values of a table, with one tree and with many shards; and errors in short entries."""
    leads, ref = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("leads", "ref_values"))
    one, many = (sorted(map(tuple, canonical.map_values(leads, ref, shard_size=n).collect())) for n in (20_000, 9))
    assert one == many and len(one) > 100
    typed = spark.createDataFrame([("status_raw", v) for v in ("Nwe", "nw", "n", "None")] + [("country", v) for v in ("U.A.E.", "Korea (South)", "S. Africa", "Rep. of Ireland", "S'pore", "DEU", "Oesterreich", "de")], "field string, value string")
    got = {r["value"]: r["canonical"] for r in canonical.match_values(typed, ref).collect()}
    assert got == {"Nwe": "New", "nw": "New", "U.A.E.": "United Arab Emirates", "Korea (South)": "South Korea", "S. Africa": "South Africa", "Rep. of Ireland": "Ireland", "S'pore": "Singapore", "DEU": "Germany", "Oesterreich": "Austria"}


def test_tree_against_brute_force():
    from siftwell.functions.names import edits

    rng = random.Random(6)
    keys = list({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(150)})
    tree = canonical.Tree()
    for k in keys:
        tree.add(k, k.upper())
    for _ in range(60):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(2, 8)))
        assert sorted(tree.within(q, 2)) == sorted((edits(q, k), k, k.upper()) for k in keys if edits(q, k) <= 2)


# ---------- 8 and 9: tokens and mixing

TEXTS = ["Hello  world's 3rd\n\ntest", "", None, "   ", "<|endoftext|> x", "don'T 日本 \u0085 \xa0 naïve 🚚🚚", "a" * 3000 + " " * 500, "\U0002ebf0 new letters \U00016a70", "tab\tand\r\nlines \n"]


def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").withColumn("word", F.lit("w")).withColumn("ids", F.lit(1))


def test_encoding_and_round_trip(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(f"{encoding.tokenizer_folder()}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    got = encoding.encode_corpus(docs(spark).unionByName(docs(spark)))
    rows = got.collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert list(r["ids"]) == tk.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, TEXTS[r["doc_id"]]
    back = {r["doc_id"]: r["text"] for r in encoding.decode_corpus(got).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encoding.encode_corpus(docs(spark).limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown token"):
        encoding.decode_corpus(spark.createDataFrame([(1, [70000])], "doc_id bigint, ids array<int>")).collect()


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, "abc"[min(2, i // 900)] if i < 2000 else None, f"text {i}", rng.randint(0, 60)) for i in range(2100)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens bigint")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.3, 4), ("none", 0.0, 3), (None, 0.5, 1), ("a", 0.9, 9)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix_sources(d.drop("n_tokens"), d.select("doc_id", "n_tokens"), weights)
    r = {x["source"]: x for x in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        assert abs(r[s]["reached_share"] - share) < 0.01 and r[s]["most_copies"] <= r[s]["max_repeats"]
    assert r["none"]["rows_out"] == 0
    m = mixed.collect()
    assert [x["place"] for x in m] == sorted(x["place"] for x in m) and len({(x["doc_id"], x["copy_no"]) for x in m}) == len(m)
    assert all(x["text"] == f"text {x['doc_id']}" for x in m) and sum(x["n_tokens"] for x in m) == sum(x["reached_tokens"] for x in r.values())
    bound = min(r[s]["available_tokens"] * r[s]["max_repeats"] / share for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.3)))
    assert abs(sum(x["n_tokens"] for x in m) / bound - mixing.FILL) < 0.02
    assert mixing.mix_sources(d.limit(0).drop("n_tokens"), d.select("doc_id", "n_tokens"), weights)[0].count() == 0


def test_copies_are_poisson_draws(spark):
    """Of the source that bounds the total too: the counts follow the capped Poisson distribution, documents independently."""
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(10).cast("bigint").alias("n_tokens"))
    weights = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 5)], "source string, target_share double, max_repeats int")
    plan = {p["source"]: p for p in mixing.plan_mix(d, weights)}
    counts = {}
    for x in mixing.mix_sources(d.select("doc_id", "source"), d.select("doc_id", "n_tokens"), weights)[0].groupBy("source", "doc_id").count().collect():
        counts.setdefault(x["source"], []).append(x["count"])
    for s, most in (("a", 3), ("b", 5)):
        steps = [0.0, *mixing.thresholds(plan[s]["rate"], most), 1.0]
        for k in range(1, most + 1):
            assert abs(counts[s].count(k) / 10_000 - (steps[k + 1] - steps[k])) < 0.02
    assert 0 < len(counts["a"]) < 10_000 or counts["a"].count(3) < 10_000
    assert d.select(F.countDistinct(mixing.uniform(F.col("doc_id"), 17))).first()[0] == 20_000


def test_poisson_quantiles():
    import math

    for rate in (0.2, 1.0, 2.5):
        steps = mixing.thresholds(rate, 4)
        assert steps == pytest.approx([sum(math.exp(-rate) * rate**j / math.factorial(j) for j in range(k + 1)) for k in range(4)])
        assert mixing.mean_copies(rate, 60) == pytest.approx(rate)


# ---------- 10: residue


def test_residue(spark):
    talk = ["The depot counts stock by hand on Fridays.", "Someone from finance booked 45 seats.", "The night shift lead liked the pricing page.", "Marketing asked whether the plan works offline."]
    good = [" ".join(talk[(i + j) % 4] for j in range(3)) for i in range(200)]
    mention = ["The mail editor guide explains that {{first_name}} is swapped for the contact's name when the mail is sent."] * 12
    bad = ["Hi {{first_name}},\n\nThe depot counts stock by hand on Fridays.", "Dear [company],\n\nSomeone from finance booked 45 seats.", "404 Not Found\nThe page you asked for does not exist.", "Please enable JavaScript to see this page.", "Home | Products | Pricing | Contact\n\nLorem ipsum dolor sit amet quam.\n\n© X Ltd"] * 3
    texts = [*good, *mention, *bad, None, "", " \n ", "The depot counts stock by hand on Fridays. " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("passage", F.lit("p"))
    got = {r["doc_id"]: r["residue"] for r in residue.score_records(df).collect()}
    first = len(good) + len(mention)
    assert all(got[first + i] for i in range(len(bad)))
    assert not any(got[i] for i in range(first)) and not got[len(texts) - 1]
    assert not {first + len(bad) + i for i in range(3)} & set(got)
    assert residue.score_records(df.limit(0)).count() == 0


def test_residue_in_other_words(spark):
    talk = ["The depot counts stock by hand on Fridays.", "Someone from finance booked 45 seats.", "The night shift lead liked the pricing page.", "Marketing asked whether the plan works offline."]
    good = [" ".join(talk[(i + j) % 4] for j in range(3)) for i in range(400)]
    mention = [f'Support case: {f} sees "502 Bad Gateway" on their own shop, we asked their host to look.' for f in ("Alder Ltd", "Birch AG", "Cedar Oy") * 4]
    mention += ["The mail editor guide explains that {{first_name}} is swapped for the contact's name when the mail is sent."] * 12
    trusted = [f"Hi {s},\n\n{talk[0]}" for s in ("{{first_name}}", "[company]", "%name%", "##n##") * 30] + ["502 Bad Gateway\nThe server could not finish your request."] * 6
    words = "lorem tempor augue porta ipsum magna cursus velit dolor semper amet purus".split()
    filler = [" ".join(words[(i * 5 + j * k) % 12] for j in range(9)).capitalize() + "." for i, k in zip(range(6), (1, 5, 7, 11, 1, 5))]
    slots = [f"Hi {s},\n\n{talk[1]}" for s in ("FIRSTNAME LASTNAME", "XXXX", "TBD-NAME", "(name)", "%insert name here%")]
    errors = ["Diese Seite wurde nicht gefunden (Fehler 504).", "asdf asdf jkl jkl asdf qwer test test test"]
    bad = [*filler, *slots, *errors]
    texts = [*good, *mention, *trusted, *bad]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["residue"] for r in residue.score_records(df).collect()}
    first = len(texts) - len(bad)
    assert not [texts[i] for i in range(len(good) + len(mention)) if got[i]]
    assert not [texts[i] for i in range(first, len(texts)) if not got[i]]


def test_sentences_with_different_slots(spark):
    texts = ["We like {{name}} of 12.", "We like [firm] of 13.", "The guide says {{name}} of 12.", "The guide says {{name}} of 13.", "No slot of 12."]
    rows = [(t, 1, False, 0.0, residue.features(t)[0], residue.features(t)[1], *(residue.slot_frame(t) if residue.features(t)[1] else (None, None))) for t in texts]
    df = spark.createDataFrame(rows, "passage string, n bigint, trusted boolean, start double, cells array<int>, has_slot boolean, frame string, slots string")
    got = {r["passage"]: residue.VARIED in r["cells"] for r in residue.with_variety(df).collect()}
    assert [got[t] for t in texts] == [True, True, False, False, False]


def test_slots():
    for text in ("{a}", "{{ first_name }}", "[[x]]", "[FNAME]", "${company}", "%Your Company%", "##n##", "@@n@@", "<<n>>", "<%= n %>", "*|N|*", "__n__", "Hi null,", "{!n}"):
        assert residue.features(text)[1], text
    for text in ("items[7]", "a % b", '{"a": 1}', "x < y > z 5", "snake_case_name"):
        assert not residue.features(text)[1], text
