"""Every query of the core over whole tables, and its SQL twin for the side-by-side check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import EngineConfig
from siftwell.functions import clean
from siftwell.functions.similarity import char_ngrams, jaro_udf, jaro_winkler_udf
from siftwell.operators import adjudicate, blocking, classify, evaluate, ingest, resolve, scoring, tables
from siftwell.operators.components import connected_components
from siftwell.operators.moments import normalise_moments
from siftwell.plans import twins
from siftwell.session import table

CONFIG = EngineConfig()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalise_moments(table(spark, sf_dir, "leads"), table(spark, sf_dir, "origins"))
    return found.select("id", "field", "utc_micros")


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "leads")


def lead_dashboard(spark, d):
    return tables.dashboard(tables.with_source(_leads(spark, d))).select("dimension", "key", "n", "place")


def lead_filter_page(spark, d):
    return tables.page(_leads(spark, d), {"status": "QUALIFIED", "owner": " karin  dolstad "}, 50, 5)[0].select("id", "display_name", "status", "owner")


def lead_filter_total(spark, d):
    return tables.page(_leads(spark, d), {"country": "germany", "q": "an"})[1]


def lead_search(spark, d):
    return _leads(spark, d).filter(tables.predicate({"q": "VEN"})).select("id", "display_name", "company_name", "email")


def lead_export(spark, d):
    return _leads(spark, d).select("id", "display_name", "job_title", "company_name", "email", "phone_raw", "country", "status", "lifecycle_stage", "owner", "created_at", "updated_at", "lead_score", "origin").orderBy("id")


def lead_get(spark, d):
    leads = _leads(spark, d)
    return leads.join(leads.agg(F.max("id").alias("id")), "id").select("id", "display_name", "email", "status")


def norm_status(spark, d):
    return _leads(spark, d).select("id", clean.status(F.col("status_raw")).alias("canonical"), (F.col("status").eqNullSafe(clean.status(F.col("status_raw")))).alias("as_stored"))


def norm_owner(spark, d):
    return _leads(spark, d).select("id", clean.owner(F.col("owner_raw")).alias("owner"), F.col("owner").eqNullSafe(clean.owner(F.col("owner_raw"))).alias("as_stored"))


def norm_country(spark, d):
    return _leads(spark, d).select("id", clean.country(F.col("country")).alias("country"))


def norm_dates(spark, d):
    return _leads(spark, d).select("id", clean.date(F.col("created_at")).cast("string").alias("created"), clean.date(F.col("updated_at")).cast("string").alias("updated"))


def norm_phone_email(spark, d):
    digits, address = clean.phone_digits(F.col("phone_raw")), clean.email(F.col("email"))
    return _leads(spark, d).select(
        "id", digits.alias("digits"), clean.phone_key(digits).alias("phone_key"), address.alias("email"), clean.email_local(address).alias("email_local"), clean.email_domain(address).alias("email_domain"), clean.domain_root(clean.email_domain(address)).alias("domain_root"),
        F.array_join(clean.email_variants(F.col("email_local")), ",").alias("variants"),
    )


def norm_names(spark, d):
    n = clean.resolved_name(F.col("first_name"), F.col("last_name"), F.col("full_name"))
    return _leads(spark, d).select("id", *[n[k].alias(k) for k in ("first_name", "last_name", "display_name", "name_key")], F.array_join(n["name_tokens"], " ").alias("tokens"))


def company_core(spark, d):
    return _leads(spark, d).select("id", clean.company_core(F.col("company_name")).alias("company_core"), F.array_join(clean.company_tokens(F.col("company_name")), " ").alias("tokens"))


def note_markers(spark, d):
    return _leads(spark, d).select("id", clean.has_marker(F.col("notes")).alias("marked"), clean.without_marker(F.col("notes")).alias("note"))


def whole_numbers(spark, d):
    return _leads(spark, d).select("id", clean.whole_number(F.col("phone_raw")).alias("number"))


def json_rows(spark, d):
    j = F.to_json(F.struct("id", "name_tokens"))
    return _leads(spark, d).select("id", F.size(F.from_json(j, "id bigint, name_tokens array<string>")["name_tokens"]).alias("n_tokens"))


def _source(s: str) -> list:
    return [F.col(f"{s}.{k}").alias(k) for k in ("channel", "detail", "confidence", "method", "evidence", "taxonomy_gap")]


def classify_notes(spark, d):
    return _leads(spark, d).withColumn("s", F.explode(F.array(classify.extract_source(F.col("notes"))))).select("id", *_source("s"))


def classify_forms(spark, d):
    t = classify.cleaned(F.col("message"))
    f = ingest.once(table(spark, d, "form_submissions"))
    return f.withColumn("s", F.explode(F.array(classify.extract_source(F.col("message"), F.col("page_url"), classify.by_keywords(t))))).select("submission_id", *_source("s"))


def channel_histogram(spark, d):
    return tables.with_source(_leads(spark, d)).groupBy("source_channel", "source_method").agg(F.count(F.lit(1)).alias("n"))


def channel_expectation(spark, d):
    return tables.source_agreement(tables.with_source(_leads(spark, d)))


def block_pairs(spark, d):
    return blocking.block_pairs(_leads(spark, d)).select("a", "b", F.array_join("blocked_by", ",").alias("blocked_by"))


def block_stats(spark, d):
    return blocking.block_stats(_leads(spark, d))


def company_weights(spark, d):
    return resolve.corpus_weights(_leads(spark, d)).select("token", F.round("weight", 6).alias("weight"))


def char_grams(spark, d):
    g = _leads(spark, d).select("id", F.explode(char_ngrams(F.col("display_name"))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("df"))


def ngram_neighbours(spark, d):
    docs = _leads(spark, d).select("id", blocking.index_text().alias("text"))
    return blocking.ngram_neighbours(docs).select("a", "b", F.round("score", 6).alias("score"))


def _pairs(spark, d):
    m = table(spark, d, "match_pairs").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return m.distinct()


def name_similarity(spark, d):
    p = scoring.attach(_pairs(spark, d), _leads(spark, d))
    x, y = F.coalesce("a_name_key", F.lit("")), F.coalesce("b_name_key", F.lit(""))
    return p.select("a", "b", F.round(jaro_udf(x, y), 6).alias("jaro"), F.round(jaro_winkler_udf(x, y), 6).alias("jaro_winkler"))


def pair_scores(spark, d):
    s = scoring.score_pairs(_pairs(spark, d), _leads(spark, d))
    return s.select("a", "b", *[F.round(f, 6).alias(f) for f in scoring.FEATURES], F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


def pair_scores_corpus(spark, d):
    s = scoring.score_pairs(_pairs(spark, d), _leads(spark, d), resolve.corpus_weights(_leads(spark, d)))
    return s.select("a", "b", F.round("company_sim", 6).alias("company_sim"), F.round("score", 6).alias("score"))


def band_adjudicated(spark, d):
    s = adjudicate.apply_verdicts(scoring.score_pairs(_pairs(spark, d), _leads(spark, d)), adjudicate.heuristic_verdict())
    return s.select("a", "b", F.round("score_before", 6).alias("score_before"), F.round("score", 6).alias("score"), F.col("verdict.verdict").alias("verdict"))


def dup_components(spark, d):
    m = table(spark, d, "match_pairs").filter("score >= 0.7").select("a", "b")
    return connected_components(m).select("id", "root")


def dup_groups(spark, d):
    m = table(spark, d, "match_pairs").filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocked_by")))).alias("blocked_by"))
    g = resolve.groups(m.withColumn("reasons", F.array().cast("array<string>")), CONFIG.report_min)
    return resolve.ordered(g).select("group_id", F.array_join(F.transform("lead_ids", lambda x: x.cast("string")), ",").alias("lead_ids"), "size", "confidence", "max_pair_confidence", F.size("pairs").alias("n_pairs"))


def resolve_groups(spark, d):
    groups, _ = resolve.resolve(_leads(spark, d))
    return groups.select("group_id", F.array_join(F.transform("lead_ids", lambda x: x.cast("string")), ",").alias("lead_ids"), "size", "confidence")


def resolve_stats(spark, d):
    return resolve.resolve(_leads(spark, d))[1]


def submission_probe(spark, d):
    rows = tables.from_submissions(ingest.once(table(spark, d, "form_submissions")))
    return blocking.probe(rows, _leads(spark, d)).select("submission_id", "id", F.array_join("kinds", ",").alias("kinds"))


def ingest_actions(spark, d):
    x = ingest.decide(table(spark, d, "form_submissions"), _leads(spark, d))
    return x.select("submission_id", "action", "lead_id", "confidence", "needs_review", F.size("possible_duplicate_of").alias("n_possible"))


def ingest_summary(spark, d):
    return ingest.summary(ingest.decide(table(spark, d, "form_submissions"), _leads(spark, d)))


def ingest_snapshot(spark, d):
    """The origin and number of leads after the batch went in."""
    _, after = ingest.ingest(table(spark, d, "form_submissions"), _leads(spark, d))
    return after.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def patch_apply(spark, d):
    leads = _leads(spark, d)
    patches = leads.filter("country is null").select("id", F.lit("closed-won").alias("status"), F.lit("  Karin   Dolstad ").alias("owner"), F.lit(None).cast("string").alias("notes"))
    return tables.apply_patches(leads, patches, F.lit("2026-01-31")).select("id", "status", "status_raw", "owner", "updated_at")


def enrich_merge(spark, d):
    leads = _leads(spark, d)
    own = F.concat(F.lit("note "), F.col("id").cast("string"))
    new = leads.select("id", F.lit("Buyer").alias("job_title"), F.lit("Acme").alias("company_name"), F.lit("acme").alias("company_core"), F.lit("x@acme.test").alias("email"), F.lit("x").alias("email_local"), F.lit("acme.test").alias("email_domain"), F.lit("acme").alias("domain_root"), F.lit("1").alias("phone_raw"), F.lit("1").alias("phone_digits"), F.lit("1").alias("phone_key"), F.lit("Chile").alias("country"), F.lit("X Y").alias("full_name"), own.alias("notes"))
    return tables.enrich(leads, new).select("id", F.array_join("filled", ",").alias("filled"), "job_title", "company_name", "email", "country", "notes")


def id_allocation(spark, d):
    rows = ingest.once(table(spark, d, "form_submissions")).select("submission_id")
    return tables.allocate_ids(_leads(spark, d), rows, "submission_id").select("submission_id", "id")


def label_pairs(spark, d):
    return evaluate.label_pairs(_leads(spark, d), 3)


def prf_sweep(spark, d):
    m = table(spark, d, "match_pairs").filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"), F.max(F.col("verdict") == "same").alias("same"))
    c = evaluate.confusion(m, m.filter("same"))
    return c.select("threshold", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def pair_sets(spark, d):
    m = _pairs(spark, d)
    same = table(spark, d, "match_pairs").filter("a <> b and verdict = 'same'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return evaluate.pair_sets(blocking.block_pairs(_leads(spark, d)).join(m, ["a", "b"], "left_semi"), same)


def cluster_exact(spark, d):
    m = table(spark, d, "match_pairs").filter("a <> b")
    return evaluate.exact_groups(m.filter("score >= 0.9").select("a", "b"), m.filter("verdict = 'same'").select("a", "b"))


PROFILED = ["first_name", "full_name", "job_title", "company_name", "email", "phone_raw", "country", "status_raw", "owner_raw", "created_at", "notes", "lead_score"]


def profile_fill(spark, d):
    return tables.profile(_leads(spark, d), PROFILED)


def profile_slash(spark, d):
    return tables.slash_dates(_leads(spark, d), ["created_at", "updated_at"])


def csv_normalise(spark, d):
    """Raw rows (the stored leads' raw columns) through the export normaliser."""
    names = {"id": "id", "first": "first_name", "last": "last_name", "full": "full_name", "email": "email", "phone": "phone_raw", "job_title": "job_title", "company": "company_name", "country": "country", "status": "status_raw", "lifecycle": "lifecycle_stage", "source": "original_source", "owner": "owner_raw", "created": "created_at", "updated": "updated_at", "notes": "notes", "score": "lead_score"}
    rows = tables.normalised(_leads(spark, d).select(*names.values()), names)
    return rows.select("id", "display_name", "name_key", "email", "domain_root", "phone_key", "country", "status", "owner", F.col("created_at").cast("string").alias("created_at"), "lead_score", "source_channel", "source_method")


def form_normalise(spark, d):
    rows = tables.from_submissions(ingest.once(table(spark, d, "form_submissions")))
    return rows.select("submission_id", "display_name", "first_name", "last_name", "name_key", "email", "domain_root", "phone_key", "country", F.col("created_at").cast("string").alias("created_at"), "source_channel")


QUERIES = [
    p7_found, lead_dashboard, lead_filter_page, lead_filter_total, lead_search, lead_export, lead_get, norm_status, norm_owner, norm_country, norm_dates, norm_phone_email, norm_names, company_core, note_markers, whole_numbers, json_rows,
    classify_notes, classify_forms, channel_histogram, channel_expectation, block_pairs, block_stats, company_weights, char_grams, ngram_neighbours, name_similarity, pair_scores, pair_scores_corpus, band_adjudicated, dup_components, dup_groups,
    resolve_groups, resolve_stats, submission_probe, ingest_actions, ingest_summary, ingest_snapshot, patch_apply, enrich_merge, id_allocation, label_pairs, prf_sweep, pair_sets, cluster_exact, profile_fill, profile_slash, csv_normalise, form_normalise,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return twins.oracle_sql()
