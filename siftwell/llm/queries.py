"""The queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import canonical, encoding, grouping, incremental, mixing, pii, residue, survivors, variants
from siftwell.session import materialise, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "leads"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "leads"))


def _survivors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    groups = materialise(p4_found(spark, sf_dir), "groups")
    return survivors.survivors(table(spark, sf_dir, "leads"), groups, table(spark, sf_dir, "origins"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir)[0].filter("decided").select("group_id", "field", "id")


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per group: the chosen job_title and lead_score and the leads they come from."""
    of = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return _survivors(spark, sf_dir)[0].groupBy("group_id").agg(
        of("job_title", "value").alias("job_title"), of("job_title", "id").alias("job_title_from"),
        of("lead_score", "value").cast("int").alias("lead_score"), of("lead_score", "id").alias("lead_score_from"),
    )


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value judged true, one row each, however many a group keeps."""
    return _survivors(spark, sf_dir)[1].select("group_id", "field", "value", F.round(1 / (1 + F.exp(-F.col("z"))), 4).alias("p"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.check_batches(table(spark, sf_dir, "leads"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_links(grouping.same_verdicts(table(spark, sf_dir, "match_pairs")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_values(table(spark, sf_dir, "leads"), table(spark, sf_dir, "ref_values"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_pairs(table(spark, sf_dir, "leads"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.decode_corpus(encoding.encode_corpus(table(spark, sf_dir, "documents")))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    sizes = materialise(encoding.count_tokens(docs), "sizes")
    return mixing.mix_sources(docs, sizes, table(spark, sf_dir, "source_weights"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.score_records(table(spark, sf_dir, "documents")).filter("residue").select("doc_id")


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are no residue, with their texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(p10_found(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "text", "source")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_survivors, p2_values, p3_found, p4_found, p5_found, p6_found, p8_ids, p8_decoded, p9_mix, p9_shares, p10_found, p10_clean)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            WITH RECURSIVE e AS (
              SELECT a v, b u FROM match_pairs WHERE verdict = 'same' AND a <> b
              UNION SELECT b, a FROM match_pairs WHERE verdict = 'same' AND a <> b),
            r AS (SELECT v, v u FROM e UNION SELECT r.v, e.u FROM r JOIN e ON r.u = e.v)
            SELECT min(u) AS group_id, v AS id FROM r GROUP BY v""",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
