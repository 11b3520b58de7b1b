import json

import pytest

from siftwell import cli
from siftwell.engine import LeadEngine
from siftwell.operators import adjudicate, providers
from siftwell.service import Service
from siftwell.session import table
from siftwell.sources import readers


def answering(dialect, text):
    asked = []

    def post(url, body, headers, timeout):
        asked.append((url, body, headers))
        if dialect == "messages":
            return {"content": [{"type": "text", "text": text}], "usage": {"input_tokens": 7, "output_tokens": 3}}
        return {"candidates": [{"content": {"parts": [{"text": text}]}}], "usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 3}}

    return providers.Provider("p", "https://x.test/{model}", "k", "m", dialect, post=post), asked


@pytest.mark.parametrize("dialect", sorted(providers.DIALECTS))
def test_providers(dialect):
    p, asked = answering(dialect, "```json\n{\"verdict\": \"same\", \"confidence\": 1, \"reason\": \"r\"}\n```")
    assert p({"record_a": {"name": "Zoë"}})["verdict"] == "same" and p.used == {"calls": 1, "tokens_in": 7, "tokens_out": 3}
    assert asked[0][0] == "https://x.test/m" and "Zoë" in json.dumps(asked[0][1], ensure_ascii=False) and "k" in asked[0][2].values()
    for text in ("{}", "no json", '{"verdict": "maybe", "confidence": 1, "reason": ""}'):
        with pytest.raises(ValueError):
            answering(dialect, text)[0]({})
    chain = adjudicate.Chain([adjudicate.Adjudicator("bad", answering(dialect, "{}")[0]), adjudicate.Adjudicator("good", p)])
    assert chain({})["provider"] == "good"
    assert answering(dialect, '{"channel": "Event", "detail": "", "confidence": 0.5, "reason": ""}')[0].source({"note": "fair"})["channel"] == "Event"


def test_provider_from_environment():
    assert providers.from_environment({}) is None
    assert providers.from_environment({"SIFTWELL_MODEL_URL": "u", "SIFTWELL_MODEL_KEY": "k", "SIFTWELL_MODEL_NAME": "n"}).model == "n"
    with pytest.raises(ValueError):
        providers.from_environment({"SIFTWELL_MODEL_URL": "u", "SIFTWELL_MODEL_KEY": "k", "SIFTWELL_MODEL_DIALECT": "x"})


def test_usage_and_cache(spark):
    req = spark.createDataFrame([(1, 2, '{"k": 1}', "h1"), (3, 4, '{"k": 1}', "h1"), (5, 6, '{"k": 2}', "h2")], "a bigint, b bigint, request string, key string")
    say = lambda r: {"verdict": "same", "confidence": 0.5, "reason": str(r["k"]), "provider": "t", "model": None}
    answers, cache = adjudicate.ask_model(req.filter("a < 5"), say, "t")
    assert tuple(adjudicate.cache_use(req, "t", cache).first()) == (1, 1)
    answers, _ = adjudicate.ask_model(req, say, "t", cache)
    assert [(r["provider"], r["pairs"], r["requests"]) for r in adjudicate.usage(answers).collect()] == [("t", 3, 2)]


def test_service(spark, sf):
    leads = table(spark, sf, "leads").limit(20)
    s = Service(LeadEngine(spark, leads))
    key = leads.first()["id"]
    assert s.answer("GET", "/health")[1]["leads_loaded"] == 20
    status, page = s.answer("GET", "/leads?limit=3")
    assert status == 200 and page["total"] == 20 and len(page["leads"]) == 3
    assert s.answer("GET", f"/leads/{key}")[1]["id"] == key and s.answer("GET", "/leads/5")[0] == 404 and s.answer("GET", "/leads/x")[0] == 400
    assert s.answer("PATCH", f"/leads/{key}", {"status": "closed won"})[1]["status"] == "Closed Won" and s.answer("PATCH", f"/leads/{key}", {"id": 1})[0] == 400
    status, got = s.answer("POST", "/ingest", [{"name": "Zora Quent", "email": "zora@quent.test"}, {"name": "Nobody"}])
    assert status == 200 and (got["created"], got["rejected"]) == (1, 1) and got["results"][0]["lead_id"] is not None
    assert s.answer("GET", "/health")[1]["leads_loaded"] == 21 and s.answer("POST", "/ingest", [1])[0] == 400 and s.answer("GET", "/nothing")[0] == 404


def test_load_counts_and_commands(spark, tmp_path, capsys):
    (tmp_path / "e.csv").write_text("Record ID,First Name\n1,Ana\n1,Anna\nx,Bob\n2,Cy\n")
    assert tuple(readers.load_counts(readers.read_export(spark, str(tmp_path / "e.csv"))).first()) == (4, 2, 1, 1)
    cli.main(["check-model"])
    assert json.loads(capsys.readouterr().out)["provider"] == "heuristic"
    cli.main(["extract", "Referred by Ana Lima."])
    assert json.loads(capsys.readouterr().out)["channel"] == "Referral"
    with pytest.raises(SystemExit):
        cli.main(["dashboard"])
