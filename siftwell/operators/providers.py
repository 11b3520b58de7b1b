"""Model providers over HTTP for the uncertain band and for notes that no rule reads: a dialect says how a provider is spoken to.

A provider is a plain picklable object, so ask_model() can call it where the partitions are. Where and what it asks comes
from the environment: SIFTWELL_MODEL_URL, SIFTWELL_MODEL_KEY, SIFTWELL_MODEL_NAME and SIFTWELL_MODEL_DIALECT. Without a
key there is none, and the offline heuristic answers.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from siftwell.config import CHANNELS
from siftwell.operators.adjudicate import VERDICTS, unfenced


def _object(**properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


VERDICT_SCHEMA = _object(verdict={"type": "string", "enum": list(VERDICTS)}, confidence={"type": "number"}, reason={"type": "string"})
SOURCE_SCHEMA = _object(channel={"type": "string", "enum": list(CHANNELS)}, detail={"type": "string"}, confidence={"type": "number"}, reason={"type": "string"})
VERDICT_TASK = "Decide whether two contact records describe one person. Equal names at one employer can be two colleagues: answer unsure where nothing but that speaks for one. Give a confidence from 0 to 1 and one sentence of reason."
SOURCE_TASK = f"Name the channel through which a lead came in, one of {', '.join(CHANNELS)}, with its detail as the note words it, a confidence from 0 to 1 and one sentence of reason."


def capitals(schema: dict) -> dict:
    """A schema for dialects that write type names in capitals and know no additionalProperties."""
    out: dict = {"type": schema["type"].upper()}
    out |= {k: schema[k] for k in ("enum", "required") if k in schema}
    if "properties" in schema:
        out["properties"] = {k: capitals(v) for k, v in schema["properties"].items()}
    return out


@dataclass(frozen=True)
class Dialect:
    """How a request is written and an answer read: headers(key), body(model, task, text, schema), text(answer), tokens(answer) as (in, out)."""

    headers: Callable[[str], dict]
    body: Callable[[str, str, str, dict], dict]
    text: Callable[[dict], str]
    tokens: Callable[[dict], tuple[int, int]]


def _message_text(answer: dict) -> str:
    if answer.get("stop_reason") == "refusal":
        raise ValueError("the request was refused")
    return next(b["text"] for b in answer.get("content", []) if b.get("type") == "text")


DIALECTS = {
    "messages": Dialect(
        lambda key: {"x-api-key": key},
        lambda model, task, text, schema: {"model": model, "max_tokens": 1024, "system": task, "messages": [{"role": "user", "content": text}], "output_config": {"format": {"type": "json_schema", "schema": schema}}},
        _message_text,
        lambda a: (a.get("usage", {}).get("input_tokens", 0), a.get("usage", {}).get("output_tokens", 0)),
    ),
    "contents": Dialect(
        lambda key: {"x-goog-api-key": key},
        lambda model, task, text, schema: {"systemInstruction": {"parts": [{"text": task}]}, "contents": [{"role": "user", "parts": [{"text": text}]}], "generationConfig": {"temperature": 0, "responseMimeType": "application/json", "responseSchema": capitals(schema)}},
        lambda a: next(p["text"] for p in a["candidates"][0]["content"]["parts"] if "text" in p),
        lambda a: (a.get("usageMetadata", {}).get("promptTokenCount", 0), a.get("usageMetadata", {}).get("candidatesTokenCount", 0)),
    ),
}


def send(url: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


@dataclass
class Provider:
    """A model behind a URL. verdict() and source() take a request (dict) and give the answer with provider and model; they raise where the answer is malformed."""

    name: str
    url: str
    key: str
    model: str
    dialect: str = "messages"
    timeout: float = 30.0
    post: Callable[[str, dict, dict, float], dict] = send
    used: dict = field(default_factory=lambda: {"calls": 0, "tokens_in": 0, "tokens_out": 0})

    def _ask(self, task: str, text: str, schema: dict) -> dict:
        d = DIALECTS[self.dialect]
        answer = self.post(self.url.replace("{model}", self.model), d.body(self.model, task, text, schema), d.headers(self.key), self.timeout)
        tokens_in, tokens_out = d.tokens(answer)
        self.used = {"calls": self.used["calls"] + 1, "tokens_in": self.used["tokens_in"] + tokens_in, "tokens_out": self.used["tokens_out"] + tokens_out}
        got = json.loads(unfenced(d.text(answer)))
        for name, rule in schema["properties"].items():
            if name in schema["required"] and (name not in got or ("enum" in rule and got[name] not in rule["enum"])):
                raise ValueError(f"{self.name}: malformed {name}")
        return {**got, "confidence": float(got["confidence"]), "provider": self.name, "model": self.model}

    def verdict(self, request: dict) -> dict:
        return self._ask(VERDICT_TASK, json.dumps(request, ensure_ascii=False, sort_keys=True), VERDICT_SCHEMA)

    def source(self, request: dict) -> dict:
        return self._ask(SOURCE_TASK, json.dumps(request, ensure_ascii=False, sort_keys=True), SOURCE_SCHEMA)

    __call__ = verdict


def from_environment(env: dict[str, str] | None = None) -> Provider | None:
    """The configured provider, or None without a URL and a key."""
    get = lambda name, default="": (os.environ if env is None else env).get(f"SIFTWELL_MODEL_{name}", default)
    if not (get("URL") and get("KEY")):
        return None
    if (dialect := get("DIALECT", "messages")) not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect}")
    return Provider(get("PROVIDER", "model"), get("URL"), get("KEY"), get("NAME"), dialect)
