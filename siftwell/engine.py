"""The engine: one object over a lead snapshot with everything a caller of the service can ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import LIST_COLUMNS, EngineConfig
from siftwell.operators import classify, ingest, resolve, tables
from siftwell.session import exists
from siftwell.sources import readers


class LeadEngine:
    """Queries and changes over a snapshot; changes return a new engine, the old snapshot stays as it is."""

    def __init__(self, spark: SparkSession, leads: DataFrame, config: EngineConfig | None = None) -> None:
        self.spark, self.config = spark, config or EngineConfig.from_env()
        self.leads = leads if "source_channel" in leads.columns else tables.with_source(leads)

    @classmethod
    def open(cls, spark: SparkSession, snapshot: str, export: str | None = None) -> LeadEngine:
        """The snapshot at a path; made from an export if there is none yet."""
        if export and not exists(spark, snapshot):
            readers.write_snapshot(readers.load_export(spark, export), snapshot)
        return cls(spark, spark.read.parquet(snapshot))

    def health(self) -> dict:
        c = self.config
        return {"status": "ok", "leads_loaded": self.leads.count(), "thresholds": {"auto_merge": c.auto_merge, "review_low": c.review_low, "report_min": c.report_min}}

    def list_leads(self, limit: object = None, offset: object = None, **filters: str | None) -> dict:
        rows, total = tables.page(self.leads, filters, limit, offset)
        keep = [c for c in LIST_COLUMNS if c in self.leads.columns]
        return {"total": total.first()["total"], "limit": tables.checked("limit", limit, 50, 1, 500), "offset": tables.checked("offset", offset, 0, 0, 10_000_000), "filters": {k: v for k, v in filters.items() if v}, "leads": rows.select(*keep)}

    def get(self, lead_id: int) -> dict | None:
        row = self.leads.filter(F.col("id") == lead_id).first()
        return row.asDict() if row else None

    def export_csv(self, path: str, **filters: str | None) -> None:
        readers.write_csv(self.leads.filter(tables.predicate(filters)), path)

    def dashboard(self) -> DataFrame:
        return tables.dashboard(self.leads)

    def patch(self, lead_id: int, changes: dict[str, object]) -> LeadEngine:
        tables.check_patch(changes)
        if self.get(lead_id) is None:
            raise KeyError(lead_id)
        row = self.spark.createDataFrame([(lead_id, changes.get("status"), changes.get("owner"), changes.get("notes"))], "id bigint, status string, owner string, notes string")
        return LeadEngine(self.spark, tables.apply_patches(self.leads, row), self.config)

    def classify(self, df: DataFrame, text: str, page_url: str | None = None, model: Callable | None = None) -> DataFrame:
        t = F.col(text)
        answer = model(classify.cleaned(t)) if model else None
        return df.withColumn("source", classify.extract_source(t, F.col(page_url) if page_url else None, answer))

    def resolve(self, min_confidence: float | None = None, limit: int | None = None, use_adjudicator: bool = True) -> tuple[DataFrame, DataFrame]:
        return resolve.resolve(self.leads, min_confidence, limit, use_adjudicator, self.config)

    def ingest(self, forms: DataFrame) -> tuple[DataFrame, LeadEngine]:
        """(decisions, engine over the new snapshot); ingest.summary(decisions) has the counts."""
        decisions, after = ingest.ingest(forms, self.leads, self.config)
        return decisions, LeadEngine(self.spark, after, self.config)

    def profile(self, columns: list[str] | None = None) -> DataFrame:
        return tables.profile(self.leads, columns or [c for c, _ in self.leads.dtypes])
