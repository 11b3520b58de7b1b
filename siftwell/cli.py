"""python -m siftwell.cli COMMAND: the engine from a shell."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from siftwell import service
from siftwell.engine import LeadEngine
from siftwell.operators import classify, ingest, providers
from siftwell.session import build_session
from siftwell.sources import readers


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siftwell")
    p.add_argument("--snapshot", help="the folder of the lead table; extract and check-model need none")
    p.add_argument("--export", help="a CSV export to make the snapshot from if there is none")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "dashboard", "profile"):
        sub.add_parser(name)
    d = sub.add_parser("dedupe")
    d.add_argument("--min-confidence", type=float)
    d.add_argument("--limit", type=int)
    d.add_argument("--out")
    i = sub.add_parser("ingest")
    i.add_argument("path")
    e = sub.add_parser("extract", help="the channel that a note tells of")
    e.add_argument("text")
    sub.add_parser("check-model", help="what is configured and whether it answers")
    v = sub.add_parser("serve")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8080)
    a = p.parse_args(args)
    if a.command == "check-model":
        provider = providers.from_environment()
        state = {"provider": provider.name, "model": provider.model, "dialect": provider.dialect} if provider else {"provider": "heuristic", "model": None}
        try:
            state["answer"] = provider.source({"note": "We met at the trade fair."}) if provider else None
        except Exception as error:  # the state is the report
            state["error"] = str(error)
        print(json.dumps(state))
        return
    spark = build_session("siftwell-cli")
    if a.command == "extract":
        t = F.col("text")
        row = spark.createDataFrame([(a.text,)], "text string").select(classify.extract_source(t, None, classify.by_keywords(classify.cleaned(t))).alias("s")).select("s.*").first()
        print(json.dumps(row.asDict()))
        return
    if not a.snapshot:
        p.error("--snapshot is required")
    engine = LeadEngine.open(spark, a.snapshot, a.export)
    if a.command == "init":
        print(json.dumps(engine.health()))
    elif a.command == "dashboard":
        engine.dashboard().orderBy("dimension", "place").show(200, False)
    elif a.command == "profile":
        engine.profile().show(200, False)
    elif a.command == "serve":
        service.serve(engine, a.host, a.port)
    elif a.command == "dedupe":
        groups, stats = engine.resolve(a.min_confidence, a.limit)
        if a.out:
            readers.write_json(groups, a.out)
        stats.show(truncate=False)
    else:
        forms = readers.read_submissions(spark, a.path)
        decisions, after = engine.ingest(forms.withColumn("submission_id", F.monotonically_increasing_id()))
        ingest.summary(decisions).show()
        readers.write_snapshot(after.leads, f"{a.snapshot}.next")


if __name__ == "__main__":
    main()
