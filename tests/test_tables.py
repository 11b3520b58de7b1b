import json

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.engine import LeadEngine
from siftwell.operators import classify, ingest, tables
from siftwell.plans import catalog
from siftwell.session import table
from siftwell.sources import readers
from siftwell.streaming import ingest as streams

NOTES = [
    ("Booked a demo via the book-a-demo page after clicking a google ad.", "Other", "rules:paid_search", "Paid Search — Google Ads (book-a-demo page)"),
    ("Scanned our QR at the Expo North booth.", "Event", "rules:event_booth", "Expo North — Booth QR Code"),
    ("No QR at the Expo North booth, only a chat.", "Event", "rules:event_booth", "Expo North — Booth conversation (no QR scan logged)"),
    ("Referred by Ana Lima, met twice. Qualifying now.", "Referral", "rules:referral_named", "Warm intro from Ana Lima"),
    ("LinkedIn, sent us an inmail", "LinkedIn", "rules:linkedin_dm", "Inbound LinkedIn DM"),
    ("LinkedIn comment under our post", "LinkedIn", "rules:linkedin", "Comment on our post"),
    ("Saw our post and commented", "LinkedIn", "rules:social_post_inferred", "Comment on our social post (platform inferred)"),
    ("Found us through organic search, landed on the pricing page before calling", "Organic Search", "rules:organic", "Google organic search — pricing page"),
    ("Filled out the form on the careers page. No response yet.", "Website", "rules:website_form", "Website form — careers page"),
    ("web form", "Website", "rules:website_form_generic", "Website form"),
    ("cold call list", "Manual/Sales", "rules:manual_sales", "Cold outreach call"),
    ("wrote to the general inbox", "Other", "rules:general_inbox", "Inbound email to general inbox"),
    ("walk-in", "Other", "rules:walk_in", "Office walk-in"),
    ("met at a summit", "Event", "rules:event_generic", "Event touchpoint"),
    ("word of mouth", "Referral", "rules:referral_generic", "Referral"),
    ("hello", "Other", "fallback:unclassified", ""),
    (None, "Other", "fallback:unclassified", ""),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NOTES)], "i int, t string").select("i", classify.extract_source(F.col("t")).alias("s"))
    for r in df.collect():
        assert (r["s"]["channel"], r["s"]["method"], r["s"]["detail"]) == NOTES[r["i"]][1:], NOTES[r["i"]]


def test_page_and_model(spark):
    df = spark.createDataFrame([("hi", "/blog/post-one/", None), ("hi", "", None), ("  ", None, None), ("referral", "/x", None)], "t string, p string, z string")
    got = [r["s"] for r in df.select(classify.extract_source(F.col("t"), F.col("p"), classify.by_keywords(F.col("t"))).alias("s")).collect()]
    assert (got[0]["method"], got[0]["detail"]) == ("rules:page_url_fallback", "Website form — blog / post one page")
    assert got[1]["method"] == "llm:heuristic" and got[2]["method"] == "fallback:unclassified" and got[3]["method"] == "rules:referral_generic"


def test_filters(spark, sf):
    leads = table(spark, sf, "leads")
    rows, total = tables.page(leads, {"status": "new"}, 3, 1)
    assert rows.count() == 3 and total.first()["total"] == leads.filter("status = 'New'").count()
    assert leads.filter(tables.predicate({"q": "%"})).count() == 0
    assert leads.filter(tables.predicate({})).count() == leads.count()
    for bad in ({"limit": "x"}, {"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            tables.page(leads, {}, bad.get("limit"), bad.get("offset"))
    with pytest.raises(ValueError):
        tables.predicate({"colour": "red"})


def test_patch(spark, sf):
    engine = LeadEngine(spark, table(spark, sf, "leads"))
    first = engine.leads.agg(F.min("id")).first()[0]
    after = engine.patch(first, {"status": "closed won", "owner": " A  B "})
    row = after.get(first)
    assert (row["status"], row["status_raw"], row["owner"]) == ("Closed Won", "closed won", "A B")
    for bad, error in (({"email": "x"}, ValueError), ({}, ValueError), ({"status": "nope"}, ValueError), ({"status": 3}, ValueError)):
        with pytest.raises(error):
            engine.patch(first, bad)
    with pytest.raises(KeyError):
        engine.patch(-1, {"notes": "x"})
    assert engine.get(-1) is None and engine.health()["leads_loaded"] == engine.leads.count()


def test_ingest_is_idempotent(spark, sf):
    forms, leads = table(spark, sf, "form_submissions"), table(spark, sf, "leads")
    d, after = ingest.ingest(forms, leads)
    s = ingest.summary(d).first()
    assert s["processed"] == forms.select("submission_id").distinct().count() == s["created"] + s["updated"] + s["rejected"]
    assert after.count() == after.select("id").distinct().count() and after.filter("origin = 'form'").count() > leads.filter("origin = 'form'").count()
    touched = after.join(leads.select("id", F.col("status").alias("s"), F.col("owner").alias("o")), "id")
    assert touched.filter("not (status <=> s) or not (owner <=> o)").count() == 0


def test_rejects_without_contact(spark, sf):
    row = table(spark, sf, "form_submissions").limit(1).withColumn("email", F.lit(" ")).withColumn("phone", F.lit(None).cast("string"))
    assert ingest.decide(row, table(spark, sf, "leads")).first()["action"] == "rejected"


def test_csv_and_json(spark, tmp_path):
    path = tmp_path / "export.csv"
    head = ",".join(readers.EXPORT_COLUMNS)
    blank = dict.fromkeys(readers.EXPORT_COLUMNS, "")

    def line(**kw):
        return ",".join('"' + str((blank | {k.replace("_", " "): v for k, v in kw.items()})[c]).replace('"', '""') + '"' for c in readers.EXPORT_COLUMNS)

    path.write_text("﻿" + "\n".join([head, line(Record_ID="7", First_Name="Ana", Last_Name="Lima", Notes='two\nlines "quoted"'), line(Record_ID="x", First_Name="No"), line(Record_ID="7", First_Name="Ana", Last_Name="Lima-Sol")]), encoding="utf-8")
    rows = readers.load_export(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["last_name"] == "Lima-Sol" and json.loads(rows[0]["raw_json"])["Record ID"] == "7"
    assert readers.read_export(spark, str(path)).count() == 3
    (tmp_path / "f.json").write_text(json.dumps([{"name": "A B", "email": "a@b.c"}, {"message": "hi"}]))
    assert readers.read_submissions(spark, str(tmp_path / "f.json")).filter("email is null").count() == 1
    engine = LeadEngine(spark, readers.load_export(spark, str(path)))
    engine.export_csv(str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1


def test_id_allocation(spark):
    leads = spark.createDataFrame([(100,)], "id bigint")
    rows = spark.createDataFrame([(s,) for s in "dcbae"], "s string")
    got = {r["s"]: r["id"] for r in tables.allocate_ids(leads, rows, "s").collect()}
    assert got == {"a": 101, "b": 102, "c": 103, "d": 104, "e": 105}
    assert tables.allocate_ids(leads.limit(0), rows, "s").agg(F.min("id")).first()[0] == 100_000_001


def test_profile(spark):
    df = spark.createDataFrame([("a", " "), ("a", None), (None, "")], "x string, y string")
    got = {r["column"]: r for r in tables.profile(df, ["x", "y"]).collect()}
    assert (got["x"]["filled"], got["x"]["fill_pct"], got["x"]["distinct_values"]) == (2, 66.7, 1) and got["y"]["always_empty"]


def test_stream(spark, sf, tmp_path):
    forms = table(spark, sf, "form_submissions").withColumn("received_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    forms.limit(6).coalesce(1).write.json(str(tmp_path / "in"))
    state = {"leads": table(spark, sf, "leads")}
    seen = []

    def save(decisions, after, batch_id):
        seen.append(decisions.count())
        state["leads"] = after

    q = streams.ingest_stream(streams.submissions(spark, str(tmp_path / "in")), lambda: state["leads"], save, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(seen) == forms.limit(6).select("submission_id").distinct().count()


SMALL = ["lead_dashboard", "norm_status", "norm_country", "norm_dates", "norm_names", "company_core", "classify_notes", "classify_forms", "block_pairs", "company_weights", "ngram_neighbours", "pair_scores", "pair_scores_corpus", "dup_groups", "resolve_groups", "resolve_stats", "submission_probe", "ingest_actions", "ingest_summary", "ingest_snapshot", "prf_sweep", "csv_normalise"]


@pytest.mark.parametrize("name", SMALL)
def test_sql_twin(spark, sf, name):
    con = duckdb.connect()
    for t in ("leads", "form_submissions", "match_pairs"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == want


def test_submissions_as_lines_and_as_an_array(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"name": "A", "email": "a@x.test"}\n\n{"name": "B"}\n{"name": "C", "phone": "1"}\n')
    (tmp_path / "array.json").write_text('\n [{"name": "D"},\n  {"name": "E",\n   "message": "two\\nlines"}]\n')
    assert [r["name"] for r in readers.read_submissions(spark, str(tmp_path / "lines.json")).orderBy("name").collect()] == ["A", "B", "C"]
    assert [r["name"] for r in readers.read_submissions(spark, str(tmp_path / "array.json")).orderBy("name").collect()] == ["D", "E"]
    assert readers.read_submissions(spark, str(tmp_path)).count() == 5


def test_open_keeps_a_snapshot_that_is_there(spark, sf, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    table(spark, sf, "leads").limit(3).write.parquet(path)
    assert LeadEngine.open(spark, path, export="/nowhere.csv").leads.count() == 3


def test_the_last_patch_counts(spark, sf):
    leads = table(spark, sf, "leads").limit(1)
    k = leads.first()["id"]
    patches = spark.createDataFrame([(k, "new", "Zoe", None, 1), (k, "nonsense", None, "n", 2), (k, "closed won", "Ana", None, 3)], "id bigint, status string, owner string, notes string, at int")
    r = tables.apply_patches(leads, patches, F.lit("2026-01-31"), "at").first()
    assert (r["status"], r["owner"], r["notes"], r["updated_at"]) == ("Closed Won", "Ana", "n", "2026-01-31")
    same = tables.apply_patches(leads, patches.filter("at = 2").withColumn("notes", F.lit(None).cast("string")), F.lit("2026-01-31")).first()
    assert same["updated_at"] == leads.first()["updated_at"]
