"""Provider adapters for two common shapes of HTTP model services; the way to post is injected.

Tests and replays never need a network.  Adapters are plain objects, so they travel to the executors.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from loomfield.operators.coerce import ProviderError, Request, Response

MAX_TOKENS, TIMEOUT = 4096, 120.0
RETRYABLE = frozenset({408, 409, 429})

Post = Callable[[str, dict, dict, float], tuple[int, dict]]


def post_json(url: str, headers: dict, body: dict, timeout: float) -> tuple[int, dict]:
    sent = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(sent, timeout=timeout) as got:
            return got.status, json.load(got)
    except urllib.error.HTTPError as e:
        return e.code, {"error": e.read().decode("utf-8", "replace")}
    except OSError as e:
        raise ProviderError(str(e), retryable=True) from None


def checked(status: int, body: dict) -> dict:
    if status >= 400:
        raise ProviderError(f"status {status}: {body.get('error')}", retryable=status in RETRYABLE or status >= 500)
    return body


def tool_name(schema_id: str) -> str:
    """A name of letters, digits, underscores and dashes, 64 at most."""
    return ("extract_" + re.sub(r"[^A-Za-z0-9_-]", "_", schema_id))[:64]


@dataclass
class ToolCallProvider:
    """Services that answer by a forced tool call, whose input is the extracted object."""

    url: str
    model: str
    headers: dict = field(default_factory=dict)
    name: str = "extract"
    max_tokens: int = MAX_TOKENS
    timeout: float = TIMEOUT
    post: Post = post_json

    def extract(self, request: Request) -> Response:
        body = {
            "model": self.model,
            "max_tokens": self.max_tokens,
            "system": request.system_prompt,
            "messages": [*request.history, {"role": "user", "content": request.user_input}],
            "tools": [{"name": self.name, "input_schema": request.json_schema}],
            "tool_choice": {"type": "tool", "name": self.name},
        }
        got = checked(*self.post(self.url, self.headers, body, self.timeout))
        if got.get("stop_reason") == "max_tokens":
            raise ProviderError("the answer was cut", "truncated")
        found = next((b["input"] for b in got.get("content", ()) if b.get("type") == "tool_use"), None)
        if not isinstance(found, dict):
            raise ProviderError("no tool call in the answer", "no_output")
        u = got.get("usage", {})
        told = {"prompt_tokens": "input_tokens", "completion_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_write_tokens": "cache_creation_input_tokens"}
        return Response(found, {k: u.get(v) or 0 for k, v in told.items()})


@dataclass
class StructuredOutputProvider:
    """Services that answer with JSON text bound to a schema (strict dialect)."""

    url: str
    model: str
    headers: dict = field(default_factory=dict)
    name: str = "extract"
    timeout: float = TIMEOUT
    post: Post = post_json

    def extract(self, request: Request) -> Response:
        body = {
            "model": self.model,
            "messages": [{"role": "system", "content": request.system_prompt}, *request.history, {"role": "user", "content": request.user_input}],
            "response_format": {"type": "json_schema", "json_schema": {"name": self.name, "strict": True, "schema": request.json_schema}},
        }
        got = checked(*self.post(self.url, self.headers, body, self.timeout))
        choice = (got.get("choices") or [{}])[0]
        message = choice.get("message") or {}
        if choice.get("finish_reason") == "length":
            raise ProviderError("the answer was cut", "truncated")
        if message.get("refusal"):
            raise ProviderError(f"refused: {message['refusal']}", "no_output")
        try:
            found = json.loads(message.get("content") or "")
        except ValueError:
            found = None
        if not isinstance(found, dict):
            raise ProviderError("the answer is no JSON object", "no_output")
        u = got.get("usage", {})
        cached = (u.get("prompt_tokens_details") or {}).get("cached_tokens") or 0
        return Response(found, {"prompt_tokens": (u.get("prompt_tokens") or 0) - cached, "completion_tokens": u.get("completion_tokens") or 0, "cache_read_tokens": cached, "cache_write_tokens": 0})
